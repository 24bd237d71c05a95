"""What can go wrong with a request."""


class ResourceError(Exception):
    status = 500


class NotFound(ResourceError):
    status = 404


class Gone(ResourceError):
    status = 410


class PreconditionFailed(ResourceError):
    status = 412


class VersionConflict(PreconditionFailed):
    pass


class InvalidRequest(ResourceError):
    status = 400


class UnknownParameter(InvalidRequest):
    pass


class UnsupportedModifier(InvalidRequest):
    pass

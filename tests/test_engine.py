import itertools

import pytest

from fathomlake.engine import initialize
from fathomlake.errors import Gone, NotFound, PreconditionFailed, UnknownParameter, UnsupportedModifier, VersionConflict
from fathomlake.functions import extract
from fathomlake.functions.observe import Cache, SearchLog
from fathomlake.operators import bundles, terminology, transactions
from fathomlake.operators.search import stream
from fathomlake.operators.store import Store
from fathomlake.plans import parser, planner, schema
from fathomlake.plans.model import Include, SortRule
from fathomlake.plans.registry import Registry
from fathomlake.sources.definitions import Definitions
from fathomlake.sources.state import State
from fathomlake.streaming import incremental


@pytest.fixture(scope="module")
def registry():
    r = Registry({"Patient.name", "Patient.communication", "Patient.identifier", "Patient.telecom", "Patient.address", "Observation.performer"})
    for code, type, base, expression, target in [
        ("birthdate", "date", "Patient", "Patient.birthDate", []), ("active", "token", "Patient", "Patient.active", []), ("gender", "token", "Patient", "Patient.gender", []),
        ("language", "token", "Patient", "Patient.communication.language", []), ("name", "string", "Patient", "Patient.name", []), ("email", "token", "Patient", "Patient.telecom.where(system='email')", []),
        ("address-city", "string", "Patient", "Patient.address.city", []), ("identifier", "token", "Patient", "Patient.identifier", []),
        ("subject", "reference", "Observation", "Observation.subject", ["Patient"]), ("performer", "reference", "Observation", "Observation.performer", ["Patient"]), ("status", "token", "Observation", "Observation.status", []),
        ("code", "token", "Observation", "Observation.code", []), ("date", "date", "Observation", "Observation.effectiveDateTime", []), ("value", "quantity", "Observation", "Observation.valueQuantity.value", []),
    ]:
        r.define(code, type, [base], expression, target)
    return r


def ids():
    n = itertools.count(1)
    return lambda: f"00000000-0000-4000-8000-{next(n):012d}"


@pytest.fixture
def store(spark, registry, tmp_path):
    n = itertools.count(1)
    return Store(spark, str(tmp_path), registry, clock=lambda: f"2024-01-01T00:00:{next(n) % 60:02d}.000Z", new_id=ids())


def test_parse(registry):
    r = parser.parse_search("Patient", {"birthdate": ["ge1990", "lt2000"], "name:exact": "A\\,b,C", "_sort": "-birthdate,name", "_count": "5000", "_offset": "-1", "_include": "Patient:x:Y", "_revinclude:iterate": "*", "_summary": "true", "gender": "", "_total": "accurate"}, registry)
    assert [(p.code, p.values, p.prefix, p.modifier) for p in r.params] == [("birthdate", ("1990",), "ge", None), ("birthdate", ("2000",), "lt", None), ("name", ("A,b", "C"), None, "exact")]
    assert r.sort == [SortRule("birthdate", True), SortRule("name")] and r.count == 1000 and r.offset is None and r.total == "accurate"
    assert r.include == [Include("Patient", "x", "Y")] and r.revinclude == [Include("*", wildcard=True, iterate=True)]
    with pytest.raises(UnknownParameter):
        parser.parse_search("Patient", {"nope": "1"}, registry)
    chained = parser.parse_search("Observation", "subject:Patient.birthdate=ge1990", registry).params[0]
    assert (chained.chain.target_type, chained.chain.code, chained.prefix, chained.values) == ("Patient", "birthdate", "ge", ("1990",))
    assert parser.split_prefix(["ge", "lt5", "gt7"], "number") == ("lt", ("ge", "5", "7"))


def test_registry(registry):
    kinds = {p.code: (p.strategy, p.column, p.array) for p in registry.params("Patient")}
    assert kinds["name"] == ("lookup-table", "name", True) and kinds["language"] == ("token-column", "language", True) and kinds["birthdate"] == ("column", "birthdate", False) and kinds["address-city"] == ("lookup-table", "addressCity", True)
    assert {p.code: p.array for p in registry.params("Observation")}["performer"] is True


def test_plan(registry):
    r = parser.parse_search("Observation", {"subject:Patient.name": "x", "date": "2020", "status": "final", "_id": "1"}, registry)
    plan = planner.plan_search(r, registry)
    assert [p.code for p in plan.request.params] == ["_id", "status", "date", "subject"] and plan.two_phase and plan.chained and plan.selectivity == "high"
    flat = planner.plan_search(r, registry, max_chain_depth=0)
    assert len(flat.request.params) == 3 and flat.warnings and not flat.two_phase


PATIENT = {"resourceType": "Patient", "active": True, "gender": "male", "birthDate": "1990-01-15", "name": [{"family": "Smith", "given": ["John", "Q"]}, {"text": "Johnny"}], "telecom": [{"system": "email", "value": "j@x.org"}], "address": [{"city": "Rome", "line": ["1 Way"]}], "communication": [{"language": {"coding": [{"system": "urn:l", "code": "en", "display": "English"}]}}], "identifier": [{"system": "urn:i", "value": "42"}], "meta": {"profile": ["urn:p"], "tag": [{"system": "urn:t", "code": "a"}]}}


def observation(patient, status="final", **more):
    return {"resourceType": "Observation", "status": status, "subject": {"reference": f"Patient/{patient}"}, "code": {"text": "weight"}, "valueQuantity": {"value": 70.5}} | more


def test_index(registry):
    x = extract.index_resource(PATIENT | {"id": "p"}, "Patient", registry)
    assert x["__active"] == ["|true"] and x["__languageSort"] == "English" and x["__language"] == ["urn:l|en", "|en"] and x["birthdate"] == "1990-01-15" and x["__nameSort"] == "Smith John Q" and x["___tag"] == ["urn:t|a", "|a"]
    assert [d["table"] for d in x["__lookups"]].count("HumanName") == 2 and x["compartments"] == ["p"]
    o = extract.index_resource(observation("00000000-0000-4000-8000-000000000001", performer=[{"reference": "#c"}, {"reference": "urn:uuid:1"}, {"reference": "http://h/Patient/z"}]), "Observation", registry)
    assert [(e["code"], e["targetId"]) for e in o["__edges"]] == [("subject", "00000000-0000-4000-8000-000000000001"), ("performer", "z")] and o["compartments"] == ["00000000-0000-4000-8000-000000000001"] and o["value"] == 70.5


def test_store_and_search(store, registry, spark):
    p, created = store.create("Patient", PATIENT)
    assert created and store.create("Patient", PATIENT, if_none_exist={"gender": "male"}) == (p, False)
    q, _ = store.create("Patient", {"resourceType": "Patient", "gender": "female", "birthDate": "1985-05-05", "name": [{"family": "Smithers"}]})
    o, _ = store.create("Observation", observation(p["id"]))
    store.create("Observation", observation(q["id"], "draft"))
    found = lambda kind, query: sorted(r["id"] for r in store.find(kind, query, 100))
    both = sorted([p["id"], q["id"]])
    assert found("Patient", {"name": "smith"}) == both and found("Patient", {"name:exact": "Smith"}) == [p["id"]] and found("Patient", {"gender:not": "male"}) == [q["id"]]
    assert found("Patient", {"birthdate": "lt1990"}) == [q["id"]] and found("Patient", {"active:missing": "true"}) == [q["id"]] and found("Patient", {"identifier": "urn:i|42"}) == [p["id"]]
    assert found("Patient", {"_tag": "a"}) == [p["id"]] and found("Patient", {"_profile": "urn:p"}) == [p["id"]] and found("Patient", {"address-city:contains": "om"}) == [p["id"]] and found("Patient", {"_id": p["id"]}) == [p["id"]]
    assert found("Observation", {"subject:Patient.name": "smith j"}) == [o["id"]] or found("Observation", {"subject:Patient.name:exact": "Smith"}) == [o["id"]]
    assert found("Observation", {"subject:Patient.birthdate": "ge1990"}) == [o["id"]] and found("Observation", {"value": "ap70"}) and found("Observation", {"subject": f"Patient/{p['id']}"}) == [o["id"]]
    with pytest.raises(UnsupportedModifier):
        found("Patient", {"birthdate:exact": "1990"})
    s = store.searcher()
    request = parser.parse_search("Observation", {"status": "final", "_include": "Observation:subject", "_total": "accurate"}, registry)
    bundle = bundles.search_bundle(s.search(request), request, "http://h", {"status": "final"})
    assert bundle["total"] == 1 and [e["search"]["mode"] for e in bundle["entry"]] == ["match", "include"] and len(bundle["link"]) == 1
    request = parser.parse_search("Patient", {"_revinclude": "Observation:subject", "_sort": "birthdate"}, registry)
    result = s.search(request)
    assert result.included.count() == 2 and [r["id"] for r in result.page.select("id").collect()] == [q["id"], p["id"]]
    assert [r["id"] for r in s.page_in_two_phases(request).select("id").collect()] == [q["id"], p["id"]] and len(list(stream(store.frame("Patient").main))) == 2
    frame = store.compact("Patient")
    assert frame.main.count() == 2 and frame.lookups["HumanName"].count() == 3


def test_versions(store):
    p, _ = store.create("Patient", PATIENT, id="a")
    u, created = store.update("Patient", p | {"gender": "other"}, if_match=f'W/"{p["meta"]["versionId"]}"')
    assert not created and store.read("Patient", "a")["gender"] == "other" and store.read_version("Patient", "a", p["meta"]["versionId"])["gender"] == "male"
    with pytest.raises(VersionConflict):
        store.update("Patient", p, if_match=p["meta"]["versionId"])
    store.delete("Patient", "a")
    for call in (lambda: store.read("Patient", "a"), lambda: store.delete("Patient", "a"), lambda: store.update("Patient", p)):
        with pytest.raises(Gone):
            call()
    with pytest.raises(NotFound):
        store.read("Patient", "zzz")
    assert store.update("Patient", p, upsert=True)[1]
    rows = bundles.history_entries(store.history("Patient", "a"), "Patient").collect()
    assert [r["method"] for r in rows] == ["PUT", "DELETE", "PUT", "POST"] and rows[1]["content"] is None
    assert bundles.history_bundle(rows)["total"] == 4 and store.history("Patient", cursor=3, limit=1).first()["versionSeq"] == 2
    store.create("Patient", PATIENT, id="b")
    with pytest.raises(PreconditionFailed):
        store.conditional_update("Patient", {"active": "true"}, PATIENT)
    assert store.conditional_delete("Patient", {"active": "true"}) == 2


def test_bundles(store):
    entries = [{"fullUrl": "urn:uuid:1", "resource": PATIENT, "request": {"method": "POST", "url": "Patient"}}, {"resource": observation("x") | {"subject": {"reference": "urn:uuid:1"}}, "request": {"method": "POST", "url": "Observation"}}, {"request": {"method": "DELETE", "url": "Patient/none"}}]
    out = transactions.transaction(store, {"entry": entries})["entry"]
    assert [e["response"]["status"] for e in out] == ["201", "201", "204"] and out[1]["resource"]["subject"]["reference"] == out[0]["response"]["location"]
    bad = transactions.transaction(store, {"entry": [entries[0], {"request": {"method": "GET", "url": "Patient/none"}}]})["entry"]
    assert [e["response"]["status"] for e in bad] == ["500"] and store.state("Patient").count() == 1
    mixed = transactions.batch(store, {"entry": [entries[0], entries[2], {"resource": PATIENT | {"id": "k"}, "request": {"method": "PUT", "url": "Patient/k"}}]})["entry"]
    assert [e["response"]["status"] for e in mixed] == ["400", "404", "201"]


def test_schema(registry, spark):
    t = schema.table_set("Patient", registry)
    assert "__gender" in t.main.names and "compartments" in t.main.names and "CREATE TABLE" in t.ddl()["Patient_History"]
    old = schema.snapshot(registry)
    new = {k: {"columns": dict(v["columns"]), "expressions": dict(v["expressions"])} for k, v in old.items()}
    new["Patient"]["columns"]["height"] = "double"
    new["Patient"]["expressions"]["height"] = "Patient.height"
    packages = schema.Packages()
    assert packages.initialize("core", "1", old)[0] == "new" and packages.initialize("core", "1", old)[0] == "consistent"
    status, deltas = packages.initialize("core", "2", new)
    assert status == "upgrade" and [d.kind for d in deltas] == ["ADD_COLUMN", "REINDEX"]
    packages.run_jobs(lambda table: 7)
    assert packages.job_counts() == {"pending": 0, "running": 0, "completed": 1, "failed": 0}
    m = schema.Migrations([(1, "a", lambda s: s + 1, lambda s: s - 1), (2, "b", lambda s: s * 2, lambda s: s // 2)])
    assert m.up(1) == 4 and m.status()["current"] == 2 and m.down(4) == 1 and schema.load_platform(Registry()).types() == sorted(schema.PLATFORM)


def test_migrate(spark):
    deltas = [schema.Delta("ADD_COLUMN", "T", "b", "array<string>"), schema.Delta("ALTER_COLUMN", "T", "a", "array<string>", "string")]
    up = schema.migrate(spark.createDataFrame([("x",), (None,)], "a string"), deltas, "T")
    assert [tuple(r) for r in up.collect()] == [(["x"], None), (None, None)]
    assert [tuple(r) for r in schema.migrate(up, deltas, "T", back=True).collect()] == [("x",), (None,)]


def test_terminology(spark):
    t, c = terminology.Terminology(spark), terminology.Conformance(spark)
    rows = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B"), ("s", "a", "A2")], terminology.CODES)
    assert t.codes.insert(rows) == 2 and t.codes.insert(rows) == 0 and t.lookup("s", "a") == "A" and t.lookup("s", "z") is None
    t.value_sets.put(spark.createDataFrame([("u", "1", "n", "x")], terminology.VALUE_SETS))
    t.value_sets.put(spark.createDataFrame([("u", "1", "n", "y"), ("u", "0", "n", "z")], terminology.VALUE_SETS))
    assert [r["content"] for r in t.versions("u").collect()] == ["z", "y"]
    guide = [{"resourceType": "CodeSystem", "id": "c", "url": "s", "concept": [{"code": "1", "concept": [{"code": "1.1", "concept": [{"code": "1.1.1"}]}]}, {"code": "2"}]}, {"resourceType": "StructureDefinition", "id": "e", "type": "Extension"}, {"resourceType": "StructureDefinition", "id": "p", "type": "Patient"}, {"id": "broken"}]
    done = terminology.import_guide(c, t, spark, "ig", guide)
    assert done["concepts"] == 4 and len(done["errors"]) == 1 and {r["bucket"]: r["n"] for r in c.index("ig").collect()} == {"profiles": 1, "extensions": 1, "codeSystems": 1}
    assert [r["code"] for r in t.tree("s").collect()] == ["1", "2", "1.1", "1.1.1"] and t.descendants("s", "1").count() == 2 and [r["code"] for r in t.children("s", "1").collect()] == ["1.1"]


def test_cache_and_log():
    now = [0.0]
    c = Cache(2, 10, "lru", lambda: now[0])
    c.put("P", "1", 1), c.put("P", "2", 2), c.get("P", "1"), c.put("P", "3", 3)
    assert c.get("P", "2") is None and c.get("P", "1") == 1
    now[0] = 11
    assert c.sweep() == 2 and c.stats()["size"] == 0
    log = SearchLog(2)
    for ms in (5, 1000, 20):
        log.add("P", ms, 1)
    assert log.stats() == {"count": 2, "avg": 510, "max": 1000, "min": 20, "slow": 1}


def test_streaming(spark, store, tmp_path):
    from fathomlake.streaming.incremental import load_stream, window_counts

    spark.createDataFrame([("1", '{"gender": "male"}', "2024-01-01T00:00:00.000Z"), ("2", '{"gender": "female"}', "2024-01-01T00:00:00.000Z")], "id string, content string, lastUpdated string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        load_stream(store, "Patient", spark.readStream.schema("id string, content string, lastUpdated string").parquet(str(tmp_path / "in")), str(tmp_path / f"c{_}")).awaitTermination(60)
    assert store.log("Patient").count() == 2 and len(store.find("Patient", {"gender": "male"}, 5)) == 1
    q = window_counts(spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").selectExpr("cast(ts as timestamp) ts"), size="1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg({"n": "sum"}).first()[0] == 1000


def test_reads_after_compaction_and_reindexing(store):
    for k in range(3):
        store.create("Patient", PATIENT, id=f"p{k}")
    store.compact("Patient")
    store.update("Patient", PATIENT | {"id": "p1", "gender": "other"}, upsert=True)
    store.delete("Patient", "p2")
    assert store.reindex("Patient", "p0") and not store.reindex("Patient", "p2") and not store.reindex("Patient", "none")
    frame = store.frame("Patient")
    assert sorted(r["id"] for r in frame.live().select("id").collect()) == ["p0", "p1"] and frame.main.count() == 3
    assert sorted(r["id"] for r in store.compact("Patient").live().select("id").collect()) == ["p0", "p1"]
    assert [r["id"] for r in store.scan("Patient", "p0", 5).collect()] == ["p1"]


def test_paths_of_expressions():
    from fathomlake.functions.extract import path_of

    assert path_of("Patient.a.where(x='1').b.where(y).c", "Patient") == ["a", "b", "c"]
    assert path_of("(Observation.value as Quantity)", "Observation") == ["value"] and path_of("Other.a | Patient.name[0].given", "Patient") == ["name", "given"]
    assert path_of("Other.a", "Patient") is None


def test_concepts_below_are_found_once_at_any_depth(spark):
    from fathomlake.operators.terminology import CONCEPTS, Terminology

    t = Terminology(spark)
    chain = [("s", f"c{k}", f"c{k - 1}" if k else "c5", None, k) for k in range(6)]  # a circle
    t.concepts.put(spark.createDataFrame(chain, CONCEPTS))
    assert sorted(r["code"] for r in t.descendants("s", "c0").collect()) == [f"c{k}" for k in range(6)]


def test_state_outlives_its_driver(spark, tmp_path):
    path = f"{tmp_path}/state"
    r = Registry()
    r.define("a", "string", ["T"], "T.a")
    first = schema.snapshot(r)
    assert schema.Packages(State(spark, path)).initialize("core", "1", first)[0] == "new"
    assert schema.Packages(State(spark, path)).initialize("core", "1", first)[0] == "consistent"
    r.define("b", "string", ["T"], "T.b")
    packages = schema.Packages(State(spark, path))
    assert packages.initialize("core", "2", schema.snapshot(r))[0] == "upgrade"
    packages.jobs[0]["status"] = "running"  # a driver that is lost in the middle of a job
    packages._save()
    again = schema.Packages(State(spark, path))
    assert [v.number for v in again.versions] == [1, 2] and [x["status"] for x in again.rows] == ["superseded", "active"]
    assert again.job_counts()["pending"] == 1
    again.run_jobs(lambda table: 5)
    assert schema.Packages(State(spark, path)).jobs[0] == {"id": 1, "table": "T", "status": "completed", "processed": 5}

    def fails(state):
        raise ValueError

    steps = [(1, "a", lambda s: s + 1, lambda s: s - 1), (2, "b", fails, fails)]
    kept = State(spark, f"{tmp_path}/migrations")
    with pytest.raises(ValueError):
        schema.Migrations(steps, kept).up(1)
    assert schema.Migrations(steps, kept).status() == {"current": 1, "applied": [1], "pending": [2]}
    assert schema.Migrations(steps, kept).down(2) == 1 and schema.Migrations(steps, kept).status()["current"] == 0


def test_definitions_make_a_registry(spark, tmp_path):
    structure = {"resourceType": "StructureDefinition", "url": "u/Pet", "type": "Pet", "kind": "resource", "snapshot": {"element": [{"path": "Pet", "max": "*"}, {"path": "Pet.owner", "max": "*"}, {"path": "Pet.nick", "max": "1"}]}}
    base = {"resourceType": "StructureDefinition", "url": "u/DomainResource", "type": "DomainResource", "kind": "resource", "abstract": True}
    parameters = [{"resource": {"resourceType": "SearchParameter", "code": c, "type": t, "base": ["Pet", "DomainResource"], "expression": f"Pet.{c}"}} for c, t in (("owner", "reference"), ("nick", "string"))]
    found = Definitions([structure, base, {"resourceType": "ValueSet", "url": "v", "id": "x"}, {"resourceType": "StructureDefinition", "url": "u/Bare", "type": "Bare", "kind": "resource"}, {"resourceType": "Bundle", "entry": parameters}])
    assert found.structure("u/Pet") is structure and found.value_set("v")["id"] == "x" and found.value_set("w") is None and found.code_system("v") is None
    r = found.registry()
    assert found.resource_types() == r.types() == ["Bare", "Pet"] and r.get("Pet", "owner").array and not r.get("Pet", "nick").array
    engine = initialize(spark, str(tmp_path), found)
    engine.store.create("Pet", {"nick": "Rex"}, id="1")
    assert engine.status == "new" and engine.store.find("Pet", "nick=rex", 5)[0]["id"] == "1" and initialize(spark, str(tmp_path), found).status == "consistent"


def test_latest_versions_of_a_stream(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")]
    for k, part in enumerate((rows[:2], rows[2:])):  # two batches: the second replaces what the first showed
        spark.createDataFrame(part, "id string, versionSeq long, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string, versionSeq long, content string").parquet(f"{tmp_path}/in")
        query = incremental.latest_versions(stream).writeStream.outputMode("complete").format("memory").queryName(f"latest{k}").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("latest1").collect()) == [("a", 3, "z"), ("b", 2, "y")]


def test_wildcard_includes_read_the_contents_of_the_page_alone(spark):
    from fathomlake.operators.search import Searcher
    from fathomlake.sources import tables

    s = Searcher(tables.catalog(spark, "/root/testdata/sf0.001"), tables.registry())
    page = spark.createDataFrame([("7",)], "id string")
    found = s.references("Order", page, Include("Order", wildcard=True))
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
    assert len(below) == 2 and "Join LeftSemi" in below[1].partition("Relation")[0]  # contents are searched after the join with the page's ids


def test_whole_schema_and_plans(registry, spark):
    made = schema.schema_ddl(registry)
    assert {"Patient", "Patient_History", "Observation_References", "HumanName", "Address", "ContactPoint", "Identifier"} <= set(made)
    old = schema.snapshot(registry)
    new = {k: {"columns": dict(v["columns"]), "expressions": dict(v["expressions"])} for k, v in old.items()}
    new["Patient"]["columns"]["height"] = "double"
    new["Patient"]["expressions"]["height"] = "Patient.height"
    made = schema.plan(old, new)
    rows = spark.createDataFrame([("1",)], "id string")
    assert made.reindex == ["Patient"] and made.up(rows, "Patient").columns == ["id", "height"] and made.down(made.up(rows, "Patient"), "Patient").columns == ["id"]


def test_extractor_in_place_of_paths(spark, tmp_path):
    r = Registry()
    r.define("owner", "reference", ["Pet"], "Pet.owner", ["Person"])
    r.define("nick", "string", ["Pet"], "Pet.nick")
    store = Store(spark, str(tmp_path), r, new_id=ids(), extractor=lambda resource, p: [resource["fields"][p.code]])
    store.create("Pet", {"fields": {"owner": "Person/7", "nick": "Rex"}}, id="1")
    assert store.find("Pet", "nick=rex&owner=Person/7", 5)[0]["id"] == "1"
    assert [tuple(x) for x in store.frame("Pet").references.select("targetType", "targetId", "code").collect()] == [("Person", "7", "owner")]


def test_expansions_and_indexes(spark):
    t, c = terminology.Terminology(spark), terminology.Conformance(spark)
    for version, text in (("1", "a"), ("1", "b"), ("2", "c")):
        t.keep_expansion("u", version, text, "2024-01-01")
    assert (t.expansion("u", "1"), t.expansion("u", "2"), t.expansion("v", "1")) == ("b", "c", None)
    t.forget_expansion("u", "1")
    assert t.expansion("u", "1") is None and t.expansion("u", "2") == "c"
    t.forget_expansion("u")
    assert t.expansions.count() == 0
    c.structures.put(spark.createDataFrame([("x", "ig", "u/x", "Patient", "resource", "u/b", "constraint"), ("y", "ig", "u/y", "Patient", "resource", "u/x", "constraint")], c.structures.rows.schema))
    assert c.structure(id="x")["url"] == "u/x" and c.structure(url="u/y")["id"] == "y" and c.structure(url="z") is None
    assert c.structures_of("Patient").count() == 2 and c.derived_from("u/x").first()["id"] == "y"
    c.parameters.put(spark.createDataFrame([("ig", "name", "string", "Patient", "Patient.name", "u/n"), ("ig", "age", "number", "Patient", "Patient.age", "u/a")], c.parameters.rows.schema))
    assert [x["code"] for x in c.parameters_of("ig").collect()] == ["age", "name"] and c.parameters_named("name").first()["url"] == "u/n"

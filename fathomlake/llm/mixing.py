"""Soft-membership mixing: domain posteriors from a classifier, document rates from projected-gradient least squares."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import saved

#: Share of the mixed tokens that each domain is to have.
TARGETS = {"clean": 0.84, "junk": 0.05, "toxic": 0.11}
SPACE = " \t\n\x0b\f\r"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The labelled table's domains; null where neither label is known."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "junk").when(quality.isNotNull(), "clean")


#: Sets of characters whose share of a text is a feature, in LEVELS levels.
SIGNS = ("#*$%&", "!", "|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
LEVELS = 5
#: Documents' worth of the pooled frequency that each domain's frequencies are shrunk by, so that a rare domain does not draw every rare word.
SMOOTHING = 8.0
#: Least G statistic of a word bucket between a domain and the others: chance reaches it once in 1,000 buckets.
EVIDENCE = 10.83

#: Features in a row of the table of their places: a power of two.
ROW = 512
#: Log odds of a domain that no labelled document shows: its posteriors are 0.
UNKNOWN = -1e6


def word_buckets(text: Column, buckets: int) -> Column:
    """The words, hashed to 0 .. buckets - 1."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+"))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def signs(text: Column, words: Column, buckets: int) -> Column:
    """A feature for each of SIGNS and one for the share of different words, numbered from buckets on."""
    t = F.coalesce(text, F.lit(""))
    share = [F.regexp_count(t, F.lit("[" + "".join(c if c.isalnum() else "\\" + c for c in chars) + "]")) * 20 / F.greatest(F.length(t), F.lit(1)) for chars in SIGNS]
    share.append(F.size(F.array_distinct(words)) * LEVELS / F.greatest(F.size(words), F.lit(1)))
    return F.array(*[F.least(F.floor(x), F.lit(LEVELS - 1)).cast("int") + (buckets + i * LEVELS) for i, x in enumerate(share)])


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], *, id_col: str, text_col: str, buckets: int, max_rows: int) -> tuple[list[float], dict[int, list[float]]]:
    """Naive Bayes over word_buckets and signs: each domain's log odds against the first, and those of the features.

    Fitted on at most max_rows labelled ids of docs, in each domain those of least hash; a rare domain's are all used before
    a common one's share grows. Which domains occur, and how often, is counted over all labelled ids of docs. All word buckets that tell a domain apart surely (EVIDENCE)
    are kept, and only they are collected.
    """
    known = labels.select(F.col(id_col).alias("__id"), domain_of(F.col("quality"), F.col("toxic")).alias("__domain")).where(F.col("__domain").isin(*domains)).dropDuplicates(["__id"])
    known = saved(known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi"))
    labelled = {r["__domain"]: r["n"] for r in known.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("__domain") == d).orderBy(F.xxhash64("__id"), "__id").limit(n) for d, n in quotas(labelled, max_rows).items()]
    known = functools.reduce(DataFrame.union, parts, known.limit(0))
    known = F.broadcast(known)  # max_rows ids, and one more for each domain, at most
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(known, "__id").withColumn("__w", word_buckets(F.col("__text"), buckets))
    rows = saved(rows.select("__domain", F.concat(F.array_distinct("__w"), signs(F.col("__text"), F.col("__w"), buckets)).alias("__f")))
    documents = {r["__domain"]: r["n"] for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
    held = saved(rows.select("__domain", F.explode("__f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("__domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]))
    # words are counted among all words of a domain's documents, so that long documents of one domain don't make every word tell of it
    whole = held.where(F.col("f") < buckets).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(domains))]).first()
    words = {d: whole[f"n{i}"] or 0 for i, d in enumerate(domains)}
    of = lambda f, d: words[d] if f < buckets else documents.get(d, 0)
    evidence = F.array_max(F.array(*[g_statistic(F.col(f"n{i}"), words[d], F.col("n") - F.col(f"n{i}"), sum(words.values()) - words[d]) for i, d in enumerate(domains)]))
    found = {r["f"]: r for r in held.where((F.col("f") >= buckets) | (evidence >= EVIDENCE)).collect()}
    counts = {(d, f): r[f"n{i}"] for f, r in found.items() for i, d in enumerate(domains)}
    features = [*sorted(f for f in found if f < buckets), *range(buckets, buckets + LEVELS * (len(SIGNS) + 1))]

    def share(d: str, f: int) -> float:
        """Of a domain's words, or documents: those with the feature, shrunk to the share among all domains."""
        everyone = sum(of(f, x) for x in domains)
        weight = SMOOTHING * (everyone / max(1, sum(documents.values())))
        pooled = (sum(counts.get((x, f), 0) for x in domains) + 0.5) / (everyone + 1.0)
        return (counts.get((d, f), 0) + weight * pooled) / (of(f, d) + weight) if weight else 1.0

    absent = [UNKNOWN if labelled and not labelled.get(d) else 0.0 for d in domains]
    prior = [math.log((labelled.get(d, 0) + 1) / (labelled.get(domains[0], 0) + 1)) + a - absent[0] for d, a in zip(domains, absent, strict=True)]
    return prior, {f: [math.log(share(d, f) / share(domains[0], f)) for d in domains] for f in features}


def quotas(labelled: dict[str, int], most: int) -> dict[str, int]:
    """How many of each domain's labelled ids are used: `most` in all, at least one of each, the rest shared evenly as far as they reach."""
    out, left = {}, most
    for i, d in enumerate(sorted(labelled, key=lambda d: (labelled[d], d))):
        out[d] = min(labelled[d], max(1, left // (len(labelled) - i)))
        left -= out[d]
    return out


def g_statistic(a: Column, n: int, b: Column, m: int) -> Column:
    """Of a in n against b in m: twice the log likelihood of two shares over that of one."""
    term = lambda x, of: F.when(x > 0, x * F.log(x / F.lit(float(of)))).otherwise(0.0)
    apart = term(a, n) + term(n - a, n) + term(b, m) + term(m - b, m)
    return 2 * (apart - term(a + b, n + m) - term(n + m - a - b, n + m))


def constants(values: list, kind: str) -> Column:
    """An array of numbers as one literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def displaced(places: dict[int, int]) -> tuple[list[int], list[int]]:
    """Shifts by row and a table in which key f has its place at shifts[f // ROW] + f % ROW: rows of keys, laid over each other."""
    lines: dict[int, list[int]] = {}
    for f in places:
        lines.setdefault(f // ROW, []).append(f % ROW)
    shifts, table = [0] * (max(lines, default=0) + 1), {}
    for line in sorted(lines, key=lambda x: (-len(lines[x]), x)):
        shift = 0
        while any(shift + x in table for x in lines[line]):
            shift += 1
        shifts[line] = shift
        table.update({shift + x: places[line * ROW + x] for x in lines[line]})
    return shifts, [table.get(i, -1) for i in range(max(table, default=-1) + 1)]


def with_posteriors(docs: DataFrame, prior: list[float], table: dict[int, list[float]], *, text_col: str, buckets: int, prefix: str) -> DataFrame:
    """docs with <prefix>n (words) and <prefix>0, <prefix>1, ...: the posteriors. A word bucket counts once a document."""
    shifts, places = displaced({f: i for i, f in enumerate(table)})
    keys = list(table)
    shift, place, owner = constants(shifts, "int"), constants(places, "int"), constants([keys[i] if i >= 0 else -1 for i in places], "int")
    slot = lambda f: F.get(shift, F.shiftright(f, ROW.bit_length() - 1)) + f.bitwiseAND(F.lit(ROW - 1))
    out = docs.withColumn(prefix + "w", word_buckets(F.col(text_col), buckets)).withColumn(prefix + "n", F.size(prefix + "w").cast("long"))
    telling = F.filter(F.array_distinct(prefix + "w"), lambda f: F.get(owner, slot(f)) == f)  # the work doesn't grow with the table
    out = out.withColumn(prefix + "f", F.concat(telling, signs(F.col(text_col), F.col(prefix + "w"), buckets)))
    out = out.withColumn(prefix + "p", F.transform(prefix + "f", lambda f: F.get(place, slot(f))))
    for k in range(1, len(prior)):
        weight = constants([round(odds[k], 6) for odds in table.values()], "double")
        out = out.withColumn(f"{prefix}s{k}", F.lit(prior[k]) + F.aggregate(F.col(prefix + "p"), F.lit(0.0), _adder(weight)))
    top = F.greatest(F.lit(0.0), *[F.col(f"{prefix}s{k}") for k in range(1, len(prior))]) if len(prior) > 1 else F.lit(0.0)
    parts = [F.exp(F.lit(0.0) - top), *[F.exp(F.col(f"{prefix}s{k}") - top) for k in range(1, len(prior))]]
    total = sum(parts[1:], parts[0])
    out = out.withColumns({f"{prefix}{k}": x / total for k, x in enumerate(parts)})
    return out.drop(*[prefix + c for c in "wfp"], *[f"{prefix}s{k}" for k in range(1, len(prior))])


def _adder(weight: Column):
    return lambda total, place: total + F.get(weight, place)


def rate(prefix: str, v: list[float], least: float, most: float) -> Column:
    """What the steps so far make of a document's rate, projected to the permitted ones."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), sum((F.col(f"{prefix}{i}") * x for i, x in enumerate(v)), F.lit(1.0))))


def fit_rates(scored: DataFrame, targets: list[float], prefix: str, *, least: float = 0.0, most: float = math.inf, steps: int = 40, tolerance: float = 1e-4) -> tuple[list[float], list[float]]:
    """Multipliers v for which the rates 1 + posteriors . v, projected to least .. most, meet the targets; and the expected totals.

    Projected gradient descent on the squared residual of the domains' expected tokens, over one rate for each document. The
    gradient in a rate is the document's posteriors times the residual, so the sum of all steps so far is posteriors . v for
    a few numbers v, and nothing is kept by document between steps: the projection is taken lazily, of that sum. A domain's
    residual is divided by its tokens, a step under which the residual can't grow: the curvature, sum n p p', is at most
    the diagonal of sum n p, as a document's posteriors sum to 1. Each step is one aggregation over all documents. Ends where the
    largest residual is under `tolerance` of all tokens, or where the totals stand still, as they do at the bounds of the rates.
    """
    n, p = F.col(prefix + "n").cast("double"), [F.col(f"{prefix}{i}") for i in range(len(targets))]

    def totals(v: list[float]) -> list[float]:
        r = scored.agg(*[F.sum(n * rate(prefix, v, least, most) * x).alias(f"t{i}") for i, x in enumerate(p)]).first()
        return [r[f"t{i}"] or 0.0 for i in range(len(p))]

    v = [0.0] * len(targets)
    start = now = totals(v)
    scale = max(sum(targets), 1.0)
    for _ in range(steps):
        if max(abs(a - b) for a, b in zip(now, targets, strict=True)) < tolerance * scale:
            break
        v = [x + (b - a) / t if t > 0 else x for x, a, b, t in zip(v, now, targets, start, strict=True)]
        before, now = now, totals(v)
        if max(abs(a - b) for a, b in zip(now, before, strict=True)) < tolerance * scale / 20:
            break
    return v, now


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_all: bool = True, max_rate: float = 4.0, max_growth: float = 2.0, buckets: int = 1 << 18, max_fit_rows: int = 10_000) -> DataFrame:
    """Every row of docs with n_tokens (words), posteriors (a map by domain), rate, copies, and gap.

    The rates make the expected tokens of each domain meet its target share of a total, as far as their bounds permit; gap says
    how far they don't: the largest difference of a domain's expected share of that total from its target. Rates lie from 0 to
    max_rate, with keep_all from 1. The total is the present one; with keep_all as much more as it takes for no domain to shrink, up to
    max_growth times. copies rounds the rate up or down by a hash of the id, so that its mean is the rate: the targets hold for copies as
    they do for rates. A domain that no labelled document in docs shows has posteriors of 0 and takes no part: the others
    share its target. Labels only count for ids in docs; max_fit_rows of those are used, of each domain some. Words are told apart
    by hash in `buckets`; of those, all that tell a domain apart are scored. Null and empty texts have no tokens, the prior
    as posteriors and a rate like others, as have null ids; repeated rows are rated each; texts of any length are scored whole;
    an empty table gives an empty result; input columns named like a new one are replaced, others carried.
    """
    targets = TARGETS if targets is None else targets
    domains, p = sorted(targets), "__m_"
    new = ("n_tokens", "posteriors", "rate", "copies", "gap")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    prior, table = fit_classifier(docs, labels, domains, id_col=id_col, text_col=text_col, buckets=buckets, max_rows=max_fit_rows)
    whole = saved(with_posteriors(docs, prior, table, text_col=text_col, buckets=buckets, prefix=p))
    scored = saved(whole.select(p + "n", *[f"{p}{i}" for i in range(len(domains))]))
    have = scored.agg(*[F.sum(F.col(p + "n") * F.col(f"{p}{i}")).alias(f"t{i}") for i in range(len(domains))]).first()
    now = [have[f"t{i}"] or 0.0 for i in range(len(domains))]
    reached = [targets[d] if t > 0 else 0.0 for d, t in zip(domains, now, strict=True)]
    share = [x / (sum(reached) or 1.0) for x in reached]
    total = sum(now)
    if keep_all:
        total = min(max((t / s for t, s in zip(now, share, strict=True) if s > 0), default=0.0), max_growth * total)
    least = 1.0 if keep_all else 0.0
    v, expected = fit_rates(scored, [total * s for s in share], p, least=least, most=max_rate)
    gap = max((abs(t / total - s) for t, s in zip(expected, share, strict=True)), default=0.0) if total else 0.0
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    posteriors = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"{p}{i}"))])
    rated = whole.select(*docs.columns, F.col(p + "n").alias("n_tokens"), posteriors.alias("posteriors"), rate(p, v, least, max_rate).alias("rate"))
    return rated.withColumns({"copies": F.floor(F.col("rate") + part).cast("int"), "gap": F.lit(gap)})

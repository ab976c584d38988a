"""Operator 5. Personal data by weak supervision, on DataFrame functions alone.

Base spans come from four patterns and always stay. Wider patterns propose more candidates of the same kinds (written-out
e-mail addresses, telephone numbers without a plus sign, IPv6 addresses, spaced card numbers). Labelers vote on every
candidate: a strict pattern, a gazetteer (top-level domains, issuer prefixes, area codes, public ranges), words of the
context, and the characters at its edges. Expectation-maximisation over the counted vote patterns (at most 81 for a kind)
estimates how reliable each labeler is. The span classifier is a logistic one, trained on the posteriors, over what no
labeler looks at as well: the span's length, digits, separators and capitals, and what stands before and after it. Only
the counts of vote and feature patterns reach the driver, at most 81 * 2^``len(FEATURES)`` for a kind, whatever the
corpus. The classifier, written as two sums looked up by votes and features, decides which candidates are added.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so repeated rows repeat their
spans; an added span that overlaps a base span of its kind is dropped; without candidates nothing is added.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, let, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive repetitions keep the matches of the plain ones here and need no stack; the heads only skip starts that fail.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": "(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?(?:\\(at\\)|\\[at\\]|\\{at\\}) ?[A-Za-z0-9-]{1,63}(?:(?:\\.| ?(?:\\(dot\\)|\\[dot\\]|\\{dot\\}) ?)[A-Za-z0-9-]{1,63}){1,5}",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": "(?<![0-9+(])\\(?[2-9][0-9]{2}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A text without this has no match of the base pattern, or of the wide one.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": "\\+[0-9]"}
WIDE_HINT = {"email": "[(\\[{]at[)\\]}]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": "[0-9][./_][0-9]{4}[./_]", "phone": "[0-9]\\)?[ .-][0-9]{3}[ .-][0-9]{4}"}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel|@|addres",
    "ip": "\\bip\\b|host|server|address|login|client|from|proxy",
    "card": "card|visa|pay|credit|debit|karte|tarjeta|carte|account",
    "phone": "phone|tel|call|fax|mobil|contact|whatsapp|ruf",
}
#: Fixed values of the gazetteers.
GAZETTEER = {
    "email": "[.\\])}] ?(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|us|ca)$",
    "ip": "^(?!0|10\\.|127\\.|255\\.|fe80|::)",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": "^(?:\\+|\\(?[2-9])",
}
STRICT = {"email": "@", "ip": "^[0-9.]+$", "card": "^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$", "phone": "^(?:\\+[0-9]|\\([0-9]{3}\\) )"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LABELERS = 4


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """(s, e, m) of each match, leftmost first and without overlaps; places count code points, e is exclusive."""
    found = let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), lambda x: F.aggregate(
        F.arrays_zip(F.slice(x["p"], 1, F.size(x["m"])).alias("p"), x["m"].alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")),
        lambda a, y: F.struct((a["at"] + F.length(y["p"]) + F.length(y["m"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + F.length(y["p"])).alias("s"), (a["at"] + F.length(y["p"]) + F.length(y["m"])).alias("e"), y["m"].alias("m"))).alias("out")),
        lambda a: a["out"],
    ))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _votes(kind: str, text: Column, x: Column) -> list[Column]:
    """Each labeler's vote on candidate ``x``: 1 for, -1 against, 0 none."""
    before = F.lower(F.substr(text, F.greatest(x["s"] - 30, F.lit(0)) + 1, F.least(x["s"], F.lit(30))))
    after = F.substr(text, x["e"] + 1, F.lit(1))
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    spread = F.size(F.array_distinct(F.split(digits, ""))) if kind in ("card", "phone") else F.lit(9)
    return [
        F.when(x["m"].rlike(STRICT[kind]), 1).when(~_valid(kind, x["m"]), -1).otherwise(0),
        F.when(F.lower(x["m"]).rlike(GAZETTEER[kind]), 1).otherwise(-1),
        F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike("version|isbn|order|page|section|license|v$"), -1).otherwise(0),
        F.when(before.rlike("[a-z0-9_=/]$") | after.rlike("[A-Za-z0-9_=/]"), -1).when(spread <= 2, -1).otherwise(1),
    ]


FEATURES = ("long", "mostly digits", "separated", "capitals", "after a mark", "line start", "digits before", "ends a word")


def _features(text: Column, x: Column) -> list[Column]:
    """What stands in and around candidate ``x``, as the truth of each of ``FEATURES``."""
    before = F.substr(text, F.greatest(x["s"] - 12, F.lit(0)) + 1, F.least(x["s"], F.lit(12)))
    after = F.substr(text, x["e"] + 1, F.lit(1))
    n = F.length(x["m"])
    return [
        n >= 16,
        2 * F.length(F.regexp_replace(x["m"], "[^0-9]", "")) > n,
        x["m"].rlike("[ ()./_-]"),
        x["m"].rlike("[A-Z]"),
        before.rlike("[:=(<\"'] ?$"),
        before.rlike("(?:^|\n) ?$"),
        before.rlike("[0-9]"),
        (after == "") | after.rlike("[\\s.,;:!?)>\"']"),
    ]


def _spans(kind: str, text: Column, wide: bool) -> Column:
    found = _matches(text, (WIDE if wide else BASE)[kind], (WIDE_HINT if wide else HINT)[kind])
    if not wide:
        found = F.filter(found, lambda x: _valid(kind, x["m"]))

    def span(x: Column) -> Column:
        votes = reduce(lambda a, v: a * 3 + v + 1, _votes(kind, text, x), F.lit(0))
        bits = reduce(lambda a, b: a + b, [f.cast("int") * 2**i for i, f in enumerate(_features(text, x))])
        return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(not wide).alias("base"), votes.alias("votes"), bits.alias("bits"))

    return F.transform(found, span)


def candidates(text: Column) -> Column:
    """(s, k: place in ``KINDS``, e, base, votes: as a number in base 3, bits: of the features) of all base spans and
    candidates of a text."""
    return F.array_sort(F.concat(*[_spans(kind, text, wide) for kind in KINDS for wide in (False, True)]))


def _of_kind(k: int) -> Column:
    return F.size(F.filter("__spans", lambda x: x["base"] & (x["k"] == k))).cast("long")


def with_candidates(docs: DataFrame, name: str = "__spans") -> DataFrame:
    return docs.withColumn(name, let(F.coalesce(F.col("text"), F.lit("")), candidates))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over counted vote patterns: the share of true candidates, and for each labeler and class
    the chance of each vote. The start trusts the majority; small pseudo-counts keep every chance above zero."""
    posterior = {v: 1 / (1 + math.exp(-sum(v))) for v in counts}
    share, chance = 0.5, []
    for _ in range(rounds):
        good = sum(n * posterior[v] for v, n in counts.items())
        total = sum(counts.values())
        share = min(0.999, max(0.001, good / total)) if total else 0.5
        chance = []
        for j in range(LABELERS):
            table_ = [[1.0] * 3, [1.0] * 3]
            table_[1][2] += 2.0  # a labeler is held to be better than chance
            table_[0][0] += 2.0
            for v, n in counts.items():
                table_[1][v[j] + 1] += n * posterior[v]
                table_[0][v[j] + 1] += n * (1 - posterior[v])
            chance.append([[x / sum(row) for x in row] for row in table_])
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[j][1][v[j] + 1] / chance[j][0][v[j] + 1]) for j in range(LABELERS))
            posterior[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return share, chance


def unpacked(votes: int) -> tuple[int, ...]:
    return tuple(votes // 3 ** (LABELERS - 1 - j) % 3 - 1 for j in range(LABELERS))


def _described(votes: int, bits: int) -> list[float]:
    v = unpacked(votes)
    return [1.0, *[float(x) for x in v], *[float(x == 0) for x in v], *[float(bits >> i & 1) for i in range(len(FEATURES))]]


def train(counts: dict[tuple[int, int], int], rounds: int = 30) -> list[float]:
    """Weights of a logistic classifier fitted by Newton steps to the posteriors of the candidates counted by (votes, bits):
    a constant, each labeler's vote, its silence, and each feature."""
    by_votes: dict[tuple[int, ...], int] = {}
    for (votes, _), n in counts.items():
        by_votes[unpacked(votes)] = by_votes.get(unpacked(votes), 0) + n
    share, chance = reliabilities(by_votes)

    def posterior(v: tuple[int, ...]) -> float:
        odds = math.log(share / (1 - share)) + sum(math.log(chance[j][1][v[j] + 1] / chance[j][0][v[j] + 1]) for j in range(LABELERS))
        return 1 / (1 + math.exp(-max(-30, min(30, odds))))

    x = np.array([_described(*key) for key in counts])
    y = np.array([posterior(unpacked(votes)) for votes, _ in counts])
    n = np.array(list(counts.values()), dtype=float) / max(1, sum(counts.values()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.001 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.001 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w.tolist()


def fit(spans: DataFrame, name: str = "__spans") -> dict[int, list[float]]:
    """For each kind that has candidates, the weights of the trained classifier."""
    rows = spans.select(F.explode(name).alias("x")).groupBy("x.k", "x.votes", "x.bits").agg(F.count(F.lit(1)).alias("n")).collect()
    kinds: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows:
        kinds.setdefault(r["k"], {})[r["votes"], r["bits"]] = r["n"]
    return {k: train(dict(sorted(counts.items()))) for k, counts in kinds.items()}


def chosen(spans: Column, weights: dict[int, list[float]]) -> Column:
    """Base spans, and candidates that the classifier accepts and no base span of their kind overlaps."""

    def score(x: Column, w: list[float]) -> Column:
        own = 1 + 2 * LABELERS
        of_votes = [float(np.dot(w[:own], _described(v, 0)[:own])) for v in range(3**LABELERS)]
        of_bits = [float(np.dot(w[own:], _described(0, b)[own:])) for b in range(2 ** len(FEATURES))]
        return F.get(F.array(*map(F.lit, of_votes)), x["votes"]) + F.get(F.array(*map(F.lit, of_bits)), x["bits"])

    def takes(x: Column) -> Column:
        ok = [(x["k"] == k) & (score(x, w) >= 0) for k, w in sorted(weights.items())]
        free = ~F.exists(spans, lambda b: b["base"] & (b["k"] == x["k"]) & (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return x["base"] | (reduce(lambda a, b: a | b, ok) & free if ok else F.lit(False))

    return F.filter(spans, takes)


def written(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat(name(x), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and all spans, for each row of ``docs``."""
    found = cut(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "__spans"))
    weights = fit(found)
    base = F.filter("__spans", lambda x: x["base"])
    number = [_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *number, F.sha2(written(base), 256).alias("base_sha256"), written(chosen(F.col("__spans"), weights)).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each found span replaced by its kind in brackets; ``n_chars`` follows if there is one."""
    name = free_name(docs, "found_spans")
    found = cut(with_candidates(docs, name))
    weights = fit(found.select(name), name)

    def masked(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), x["k"] + 1), F.lit("]")).alias("out")))
        return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))))

    spans = chosen(F.col(name), weights)
    text = F.when(F.col("text").isNull() | (F.size(name) == 0), F.col("text")).otherwise(let(spans, masked))
    out = found.withColumn("text", text).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))

"""Secret scans in SQL functions: fixed patterns, and Markov models of random strings and identifiers.

Three kinds are found by pattern: assignments to names such as ``password``, access keys and hexadecimal
strings. Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples; other long tokens count as ``random`` when the logarithm of
the ratio of their likelihoods under both models is high enough in total and for each character.

Where SQL has only the matches of a pattern, their places follow from the lengths of what stands between.

Cases: a null or empty text has no spans; repeated rows give equal rows; other columns pass through, except
one with the name of the result; without samples of both kinds no token counts as random.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewatch.llm.tables import fresh

#: The patterns of openly written secrets.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge, and words that are ordinary identifiers when they stand in no secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: What takes the place of openly written secrets (a code point that is no character); tokens that touch it are parts of them.
BLANK = "\U0010ffff"
APART = rf"(?<![{BLANK}A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{16,}}+(?!{BLANK})"
#: Characters of an assigned value at least.
LEAST_ASSIGNED = 12
IDENTIFIER = r"[A-Za-z][A-Za-z_]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio a token needs in all, and for each pair of characters.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.5
#: Documents whose strings train the models, chosen by a hash of the text.
MAX_SAMPLE = 10_000

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's argument is, a column used in a lambda is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ends(steps: Column, base: Column) -> Column:
    """The running sum of the steps' lengths, from ``base``."""
    start = F.struct(base.alias("at"), F.expr("cast(array() as array<int>)").alias("done"))

    def add(state: Column, step: Column) -> Column:
        end = state["at"] + step["g"] + step["m"]
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(end)).alias("done"))

    return F.aggregate(steps, start, add, lambda state: state["done"])


def _running(steps: Column) -> Column:
    """``_ends`` in blocks of the root of their number: appending to an array costs its length."""
    size = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    count = F.ceil(F.size(steps) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(steps, (b - 1) * size + 1, size))

    def summed(blocks: Column) -> Column:
        total = F.transform(
            blocks, lambda block: F.struct(
                F.aggregate(block, F.lit(0), lambda s, x: s + x["g"] + x["m"]).alias("g"), F.lit(0).alias("m")
            )
        )
        return _bound(_ends(total, F.lit(0)), lambda ends: F.flatten(F.transform(
            blocks, lambda block, i: _ends(block, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)))
        )))

    return _bound(cut, summed)


def _place(gaps: Column, matches: Column, value) -> Column:
    """(start, end, value) of each match, from the stretches before the matches."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("t")))
    found = F.filter(steps, lambda s: s["t"].isNotNull())
    return _bound(found, lambda s: F.zip_with(s, _running(s), lambda x, end: F.struct(
        (end - x["m"]).alias("start"), end.alias("end"), value(x["t"]).alias("value")
    )))


def matches(text: Column, pattern: str, gate: Column, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, end, value of the group), in code points."""
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    placed = _place(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), value)
    return F.when(gate, placed).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def base_spans(text: Column) -> dict[str, Column]:
    """Openly written secrets by kind. A hexadecimal run is maximal, so is the rest of an access key."""
    assign = matches(text, ASSIGN, text.rlike(NAMES), group=2)
    return {
        "assign": F.filter(assign, lambda s: F.length(s["value"]) >= LEAST_ASSIGNED),
        "access": matches(text, ACCESS, F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)),
        "hex": matches(text, HEX, text.rlike(HEX)),
    }


def _blanked(text: Column, pattern: str, gate: Column, keep=None) -> Column:
    """The text with as many blanks in place of every match, but of those to ``keep``."""
    steps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).when(keep(m) if keep else F.lit(False), m)
                              .otherwise(F.repeat(F.lit(BLANK), F.length(m)))),
    )
    return F.when(gate, F.array_join(steps, "")).otherwise(text)


def _bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the ``most`` least hashes ``h``, one for each; only hashes are ordered, not texts."""
    least = rows.select("h").distinct().orderBy("h").limit(most + 1).agg(F.count("h"), F.max("h")).first()
    chosen = rows if least[0] <= most else rows.where(F.col("h") < least[1])
    return chosen.dropDuplicates(["h"])


def labelled_strings(docs: DataFrame, text: str = "text", most: int = MAX_SAMPLE) -> DataFrame:
    """``(value, label)`` from a bounded sample of documents: secrets as written (1), long words (0)."""
    plain = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    secret = plain.where(F.col("t").rlike(f"{NAMES}|{ACCESS}|{HEX}"))
    chosen = [_bounded_sample(side, most // 2) for side in (secret, plain)]
    found = chosen[0].withColumns(base_spans(F.col("t")))
    values = F.concat(*(F.transform(k, lambda s: s["value"]) for k in ("assign", "access", "hex")))
    words = F.regexp_extract_all(F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit(IDENTIFIER), F.lit(0))
    return found.select(F.explode(values).alias("value"), F.lit(1).alias("label")).union(
        chosen[1].select(F.explode(words).alias("value"), F.lit(0).alias("label"))
    )


def train_models(samples: DataFrame) -> np.ndarray | None:
    """Log of the ratio of both models' transition probabilities, for each pair of characters.

    Grouped counts over all samples; at most two for each pair of characters come to the driver.
    """
    size = len(ALPHABET) + 1
    pairs = samples.select(
        "label",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))),
                lambda i: _pair(F.substring(F.col("value"), i, 1), F.substring(F.col("value"), i + 1, 1)),
            )
        ).alias("pair"),
    ).where(F.length("value") > 1)
    counts = np.zeros((2, size * size))
    for row in pairs.groupBy("label", "pair").count().collect():
        counts[row["label"], row["pair"]] = row["count"]
    if not counts.sum(axis=1).all():
        return None
    smooth = counts.reshape(2, size, size) + 0.5
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel()


def _pair(a: Column, b: Column) -> Column:
    """The number of a pair of characters; all characters outside the alphabet share one place."""
    place = lambda c: F.position(c, F.lit(ALPHABET))
    return place(a) * (len(ALPHABET) + 1) + place(b)


def ratio(value: Column, table: np.ndarray) -> Column:
    """Log-likelihood ratio of a string."""
    place = lambda i: _pair(F.substring(value, i, 1), F.substring(value, i + 1, 1))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda s, i: s + F.element_at(F.lit(table), place(i) + 1)
    )


def _ranked(spans: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_secrets(docs: DataFrame, table: np.ndarray | None, text: str = "text", result: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end), by start and kind; openly written ones always stay."""
    kept = [c for c in docs.columns if c != result]
    t, names = fresh(docs, "t"), {k: fresh(docs, f"s_{k}") for k in KINDS}
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({names[k]: c for k, c in base_spans(F.col(t)).items()})
    if table is None:
        random = F.expr(f"cast(array() as {_SPANS})")
    else:
        # Tokens are looked for in the text without open secrets, so no token is compared with all of them.
        for pattern, kind, keep in (
            (ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) < LEAST_ASSIGNED),
            (ACCESS, "access", None), (HEX, "hex", None),
        ):
            df = df.withColumn(t, _blanked(F.col(t), pattern, F.size(names[kind]) > 0, keep))
        found = matches(F.col(t), APART, F.col(t).rlike(CANDIDATE))
        enough = lambda s: ratio(s["value"], table) >= F.greatest(
            F.lit(LEAST_TOTAL), LEAST_EACH * (F.length(s["value"]) - 1)
        )
        random = F.filter(found, enough)
    df = df.withColumn(names["random"], random)
    named = F.transform(
        F.array_sort(F.concat(*(_ranked(names[k], KINDS.index(k)) for k in KINDS))),
        lambda s: F.struct(
            F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"),
        ),
    )
    return df.select(*kept, named.alias(result))


def secrets_report(docs: DataFrame) -> DataFrame:
    """One row per document: openly written secrets by kind and their digest, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"), train_models(labelled_strings(docs)))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    counts = [_count(kind) for kind in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))

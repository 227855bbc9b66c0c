"""Personal data: fixed patterns, and identifiers that their contexts give away.

Matches of the fixed patterns are seeds. The words around them induce lexical patterns, and patterns
and instances (seeds and tokens of an identifier's shape) form a graph. Scores run over it until
nothing changes: a pattern is as reliable as the share of its instances that are believed, and all
instances of a reliable pattern are. Tokens of believed instances in reliable patterns are added.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column, let, whole

# The base patterns, each written so that a match is found in linear time and without recursion:
# starts that cannot be leftmost are excluded, and repeats that need no retry are possessive.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
FOUND = "found_"  # prefix of the kinds of added spans
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9@._+-]{5,}+"
CONTEXT = 64  # characters on either side in which context words are looked for
SUPPORT = 3  # different believed instances of a pattern that counts
TRUST = 0.8  # score of a pattern that is reliable

_SPAN = "struct<start:int,end:int,match:string,left:string,right:string>"


def occurrences(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap, with their places in code points and the text
    around: matches and the gaps between them are cut separately and laid end to end."""

    def placed(found: Column) -> Column:
        def along(gaps: Column) -> Column:
            parts = F.transform(
                found,
                lambda m, i: F.struct(
                    m.alias("match"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("next")
                ),
            )
            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

            def step(state: Column, p: Column) -> Column:
                begin = state["at"] + F.length(p["gap"])
                end = begin + F.length(p["match"])
                span = F.struct(
                    begin.alias("start"), end.alias("end"), p["match"].alias("match"),
                    F.right(p["gap"], F.lit(CONTEXT)).alias("left"),
                    F.left(p["next"], F.lit(CONTEXT)).alias("right"),
                )
                return F.struct(
                    end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")
                )

            return F.aggregate(parts, start, step)["spans"]

        return F.when(F.size(found) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(
            let(F.split(text, pattern, -1), along)
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    places = F.transform(F.sequence(F.lit(1), n), worth)
    return F.aggregate(places, F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(match, r"\."), lambda part: F.rlike(part, small))
    if kind == "card":
        return let(
            _digits(match), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
        )
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


NEEDED = {"email": "@", "ip": ".", "phone": "+"}  # what a text with such a match contains


def _base(text: Column, kind: str) -> Column:
    spans = F.filter(occurrences(text, BASE[kind]), lambda s: _passes(kind, s["match"]))
    if kind in NEEDED:
        return F.when(F.contains(text, F.lit(NEEDED[kind])), spans).otherwise(
            F.array().cast(f"array<{_SPAN}>")
        )
    return spans


def _patterns(left: Column, right: Column) -> Column:
    """Two words before; one before and one after. Digits in them count as one."""

    def plain(c: Column) -> Column:
        return F.filter(
            F.split(F.lower(F.translate(c, "123456789", "000000000")), r"[\x20\x09-\x0D]+"), lambda w: w != ""
        )

    def of(before: Column) -> Column:
        last = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("^"))
        prior = F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("^"))
        after = F.coalesce(F.try_element_at(plain(right), F.lit(1)), F.lit("$"))
        return F.array(F.concat_ws(" ", F.lit("L"), prior, last), F.concat_ws(" ", F.lit("C"), last, after))

    return let(plain(left), of)


def scored(edges: DataFrame) -> DataFrame:
    """Reliable patterns ``kind, pattern, score`` from distinct edges ``kind, pattern, instance``,
    where a null kind is an instance that no base pattern matches.

    A believed instance counts like a seed, which is what its score tends to when rounds go on. The
    sets only grow, so the rounds end; the score is that of the round in which a pattern became
    reliable.
    """
    spots = edges.groupBy("pattern", "instance").agg(
        F.collect_set("kind").alias("known"), F.max(F.col("kind").isNull()).alias("free")
    )
    spots = materialise(spots, "pii-spots")
    sizes = spots.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    # A pattern of fewer instances never counts.
    sizes = materialise(sizes.where(F.col("instances") >= SUPPORT), "pii-sizes")
    spots = materialise(spots.join(sizes.select("pattern"), "pattern"), "pii-graph")
    seeds = spots.select("pattern", F.explode("known").alias("kind")).groupBy("kind", "pattern").agg(
        F.count(F.lit(1)).alias("n")
    )
    seeds = materialise(seeds, "pii-seed-patterns")
    unseen = spots.where("free").drop("free")

    def reliable(counts: DataFrame) -> DataFrame:
        share = F.col("n") / F.col("instances")
        rated = counts.where(F.col("n") >= SUPPORT).join(sizes, "pattern")
        return rated.select("kind", "pattern", share.alias("score")).where(F.col("score") >= TRUST)

    found = materialise(reliable(seeds), "pii-scores")
    before, now = 0, found.count()
    while now > before:
        believed = unseen.join(found.select("kind", "pattern"), "pattern").select("kind", "instance").distinct()
        gained = (
            unseen.join(believed, "instance")
            .where(~F.array_contains("known", F.col("kind")))
            .groupBy("kind", "pattern")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        counts = seeds.unionByName(gained).groupBy("kind", "pattern").agg(F.sum("n").alias("n"))
        # The first score of a pattern is the least.
        found = materialise(
            reliable(counts).unionByName(found).groupBy("kind", "pattern").agg(F.min("score").alias("score")),
            "pii-scores",
        )
        before, now = now, found.count()
    return found


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row as ``id, base, added``: arrays of ``start, rank, end, kind``, by start and kind.

    A null or empty text has no spans. Places are code points, ends exclusive. Repeated rows have
    equal spans; copies of a text count once in the graph. An empty table gives an empty result,
    other columns are not looked at.
    """
    text = whole(column(text_column))
    matched = docs.select(
        column(id_column).alias("id"),
        F.md5(text).alias("key"),
        *[_base(text, k).alias(k) for k in KINDS],
        F.when(F.rlike(text, F.lit("[0-9@]")), occurrences(text, CANDIDATE))
        .otherwise(F.array().cast(f"array<{_SPAN}>"))
        .alias("candidates"),
    )

    def span(kind: str):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        )

    def edge(kind: str | None):
        return lambda s: F.struct(
            F.lit(kind).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.lower(s["match"]).alias("instance"), _patterns(s["left"], s["right"]).alias("patterns"),
        )

    base = F.concat(*[F.transform(k, span(k)) for k in KINDS])
    stored = matched.select("id", "key", F.sort_array(base).alias("base"), *KINDS, "candidates")
    free = F.filter(
        "candidates",
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    stored = stored.select(
        "id", "key", "base",
        F.concat(*[F.transform(k, edge(k)) for k in KINDS], F.transform(free, edge(None))).alias("edges"),
    )
    stored = materialise(stored, "pii-matches")
    edges = stored.select("key", F.explode("edges").alias("e")).select(
        "key", "e.kind", "e.start", "e.end", "e.instance", F.explode("e.patterns").alias("pattern")
    )
    edges = edges.distinct()
    trusted = scored(edges)
    wanted = edges.where("kind is null").drop("kind").join(trusted, "pattern")
    added = (
        wanted.groupBy("key", "start", "end")
        .agg(F.max(F.struct("score", "kind")).alias("best"))
        .groupBy("key")
        .agg(
            F.sort_array(
                F.collect_set(
                    F.struct(
                        "start",
                        (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("best.kind")) + 3)
                        .cast("int").alias("rank"),
                        "end",
                        F.concat(F.lit(FOUND), F.col("best.kind")).alias("kind"),
                    )
                )
            ).alias("added")
        )
    )
    added = materialise(added, "pii-added")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return stored.select("id", "key", "base").join(added, "key", "left").select(
        "id", "base", F.coalesce("added", empty).alias("added")
    )


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    one = F.transform(
        found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

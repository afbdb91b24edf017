"""Personal data by patterns and by bootstrapped context. DataFrame functions only.

Base identifiers (email, ip, card, phone) are found by regular expressions. They
seed a bootstrap: the words before and after a seed are its lexical patterns
(one word before, two words before, one word after). Identifier-like tokens,
runs of digit groups between single blanks, taken whole, and words around (at)
or [at], with or without blanks, are the candidates unless a base span overlaps
them; a candidate is an instance of
every kind whose outer form it could have. Patterns and instances form a graph:

- a pattern's score is the mean score of its distinct instances (seeds have
  1, candidates start at 0), shrunk by ``PRIOR`` so that rare patterns stay low;
- a candidate's score is the mean score of its patterns.

After ``ROUNDS`` rounds the patterns with a score of ``ACCEPT`` or more and at
least ``SUPPORT`` distinct seeds are trusted, and a candidate that a trusted pattern of
its kind surrounds is a new span. Patterns are pre-aggregated before each
shuffle; a frequent context word is only a large count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.llm.connect import written

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored forms of the four patterns: same matches, without backtracking over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TRIGGER = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
# Outer forms that a candidate of each kind may have.
LIKE = {
    "email": r"^[^@]+(?:@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9]+(?:[.,:][0-9]+){3}$",
    "card": r"^(?:[0-9Xx*][ .-]?){12,19}$",
    "phone": r"^\+?(?:[0-9][ ().-]*){7,15}$",
}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# The forms that hold blanks or a spelt-out @: words around (at), and two or more groups of digits or masking signs.
SPACED = (r"(?<!\S)(?:[^\s@]+? ?(?:\(at\)|\[at\]) ?[^\s@]++"
          r"|[+(\[\"'`{<]*+[0-9Xx*][0-9Xx*().-]*+(?: [0-9Xx*(][0-9Xx*().-]*+(?![^\s,;:!?|\"'`\]}>]))++)")
ANY = r"[0-9@]|\(at\)|\[at\]"
WRAP = "\"'`()[]{}<>.,;:!?|"
REACH = 60
ROUNDS, ACCEPT, SUPPORT, PRIOR = 3, 0.8, 5, 1.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": m.rlike(OCTETS), "card": n.between(12, 19) & F.call_function("luhn_check", _digits(m)), "phone": n.between(9, 15)}[kind]


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern from left to right: array of (start, end, m), in code points, end exclusive.

    The text is split at the matches; starts are running sums of the lengths of
    what lies between.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    step = F.aggregate(
        F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                                                x["m"].alias("m"))).alias("out")))
    return step["out"]


def _base(kind: str, text: Column) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))
    return F.when(F.contains(text, F.lit(TRIGGER[kind])), found) if TRIGGER[kind] else found


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """Lexical patterns around a span: word before, two words before, word after, within ``REACH`` characters."""
    low = F.greatest(start - REACH, F.lit(0))
    left = F.filter(F.split(F.lower(F.substring(text, low + 1, start - low)), r"\s+"), lambda w: w != "")
    right = F.filter(F.split(F.lower(F.substring(text, end + 1, F.lit(REACH))), r"\s+"), lambda w: w != "")
    word = F.try_element_at(left, F.lit(-1))
    return F.filter(F.array(F.concat(F.lit("1 "), word), F.concat(F.lit("2 "), F.try_element_at(left, F.lit(-2)), F.lit(" "), word),
                            F.concat(F.lit("3 "), F.try_element_at(right, F.lit(1)))), lambda p: p.isNotNull())


def _trusted(edges: DataFrame) -> DataFrame:
    """Patterns to trust: (kind, pattern), from distinct (kind, pattern, value, seed) edges."""
    edges = written(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    values = edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for turn in range(ROUNDS):
        patterns = (edges.join(values, ["kind", "value"]).groupBy("kind", "pattern")
                    .agg((F.sum("score") / (F.count("*") + PRIOR)).alias("score"), F.sum(F.col("seed").cast("int")).alias("seeds")))
        patterns = written(patterns, "patterns")
        if turn < ROUNDS - 1:
            values = written(edges.join(patterns.select("kind", "pattern", F.col("score").alias("p")), ["kind", "pattern"])
                             .groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(F.avg("p")).alias("score")), "values")
    return patterns.where((F.col("score") >= ACCEPT) & (F.col("seeds") >= SUPPORT)).select("kind", "pattern")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``base`` and ``spans``, arrays of (start, kind, end, m) by start and kind.

    ``kind`` is an index into ``KINDS``; ``spans`` has the base spans and the
    bootstrapped ones. Defined cases: a null or empty text has no span; rows
    are searched one by one, repeated or not; other columns are ignored;
    candidates that overlap a base span are not looked at; of new spans inside
    one another the longest is given; an empty table gives
    an empty result.
    """
    kind_span = "array<struct<start:int,kind:int,end:int,m:string>>"
    none = F.expr(f"cast(array() as {kind_span})")
    t = F.col("text")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    some = t.rlike(ANY)
    found = rows.where(some)
    for kind in KINDS:
        found = found.withColumn(kind, F.coalesce(_base(kind, t), none))
    found = found.withColumn("base", F.array_sort(F.flatten(F.array(*KINDS))))
    tokens = F.transform(F.concat(matches(t, CANDIDATE), F.filter(matches(t, SPACED), lambda x: x["m"].rlike(ANY))), lambda x: F.struct(
        (x["start"] + F.length(x["m"]) - F.length(F.ltrim(x["m"], F.lit(WRAP)))).alias("start"), F.trim(x["m"], F.lit(WRAP)).alias("m")))
    tokens = F.filter(tokens, lambda x: F.exists(F.array(*[x["m"].rlike(LIKE[k]) for k in KINDS]), lambda b: b)
                      & ~F.exists("base", lambda b: (b["start"] < x["start"] + F.length(x["m"])) & (x["start"] < b["end"])))
    found = found.withColumn("other", F.array_distinct(tokens))
    seeds = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["m"].alias("m"), _contexts(t, b["start"], b["end"]).alias("p")))
    likely = F.flatten(F.transform("other", lambda x: F.transform(
        F.filter(F.array(*[F.when(x["m"].rlike(LIKE[k]), F.lit(i)) for i, k in enumerate(KINDS)]), lambda i: i.isNotNull()),
        lambda i: F.struct(x["start"].alias("start"), i.alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m"),
                           _contexts(t, x["start"], x["start"] + F.length(x["m"])).alias("p")))))
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "key", "base", likely.alias("other"), seeds.alias("seeds")), "spans")
    edges = (found.select(F.explode("seeds").alias("s")).select("s.kind", "s.m", F.lit(True).alias("seed"), F.explode("s.p").alias("pattern"))
             .unionByName(found.select(F.explode("other").alias("s")).select("s.kind", "s.m", F.lit(False).alias("seed"), F.explode("s.p").alias("pattern")))
             .withColumnRenamed("m", "value"))
    trusted = _trusted(edges)
    new = (found.select("row", F.explode("other").alias("s")).select("row", "s.kind", "s.start", "s.end", "s.m", F.explode("s.p").alias("pattern"))
           .join(trusted, ["kind", "pattern"], "left_semi").groupBy("row", "start", "end", "m").agg(F.min("kind").alias("kind"))
           .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "m")).alias("new")))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    new = new.withColumn("new", F.filter("new", lambda x: ~F.exists("new", lambda y: inside(x, y))))
    full = (found.join(new, "row", "left")
            .select("key", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("spans")))
    clean = rows.where(F.coalesce(~some, F.lit(True))).select("key", none.alias("base"), none.alias("spans"))
    return clean.unionByName(full).withColumnRenamed("key", key)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the text of all spans."""
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))

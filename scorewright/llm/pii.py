"""Personal data in text: identifiers by their form, and more of them by the contexts that these occur in.

All of it is column expressions, joins and aggregations. Four kinds of identifier are found by their
form. They are the seeds: the one to three words before and after a seed make lexical patterns. Patterns
and the identifier-like strings at them form a bipartite graph with the seeds, on which scores are
passed back and forth: a pattern is trusted by the share of known identifiers among all that stands at
it anywhere in the corpus, an instance by the patterns that it stands at. What looks like an identifier
and stands at a pattern of high confidence is then reported too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Kinds that are found by their form, in the order in which they are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: Their patterns (fixed values). Repetitions that nothing after them could shorten are possessive, and a
#: match begins where a run of its first characters begins or where the last match ended: the matches are
#: those of the plain patterns, found in linear time and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for a kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Identifier-like strings: runs of letters, digits and what joins them, with a digit, an @, a _ or a dot between letters.
#: A run is looked at from its beginning alone, before which a few joining marks may stand, so that none is read again from its middle.
CANDIDATE = r"(?=[\p{L}0-9@_])(?<=(?:^|[^\p{L}0-9@_.+/#-])[.+/#-]{0,16})(?=[\p{L}+/#-]*+(?:[0-9@_]|\.[\p{L}0-9@_]))[\p{L}0-9@_](?:[.+/#-]*+[\p{L}0-9@_])*+"
#: What a text must hold to be searched for them.
IDENTIFIER_LIKE = r"[0-9@_]|\p{L}\.\p{L}"
#: Rounds of scoring; confidence and distinct seeds that a pattern needs.
ROUNDS, CONFIDENCE, SEEDS = 3, 0.5, 3
#: Words of a pattern, and the characters beside a match that they are looked for in; a pattern doesn't reach across another match.
MOST_WORDS, LOOK = 3, 96
#: Patterns that are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000
BEFORE = r"\s((?:\S+\s+){0,2}\S+)\s+\p{Punct}{0,3}$"
AFTER = r"^\p{Punct}{0,3}\s+(\S+(?:\s+\S+){0,2})\s"
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


#: Matches with the text before and after them, their places in blocks, and these put together; ``array(x)`` and ``[0]`` bind a name to x.
LOCATED = """
transform(array(regexp_extract_all(text, r'{pattern}', 0)), hits -> if(size(hits) = 0, cast(array() as {span}),
  transform(array(split(text, r'{pattern}', -1)), gaps ->
    transform(array(transform(hits, (hit, k) -> named_struct(
        'skip', length(gaps[k]), 'size', length(hit), 'value', hit,
        'left', lower(regexp_extract(concat(' ', right(gaps[k], {look})), r'{before}', 1)),
        'right', lower(regexp_extract(concat(left(gaps[k + 1], {look}), ' '), r'{after}', 1))))), steps ->
      transform(array(transform(sequence(1, size(steps), cast(ceil(sqrt(size(steps))) as int)), first ->
          aggregate(slice(steps, first, cast(ceil(sqrt(size(steps))) as int)), named_struct('at', 0, 'found', cast(array() as {span})),
            (done, x) -> named_struct('at', done.at + x.skip + x.size, 'found', concat(done.found, array(named_struct(
              'start', done.at + x.skip, 'end', done.at + x.skip + x.size, 'value', x.value, 'left', x.left, 'right', x.right))))))), blocks ->
        transform(array(aggregate(blocks, named_struct('at', 0, 'before', cast(array() as array<int>)),
            (done, x) -> named_struct('at', done.at + x.at, 'before', concat(done.before, array(done.at))), done -> done.before)), shift ->
          flatten(transform(blocks, (b, k) -> transform(b.found, y -> named_struct(
            'start', y.start + shift[k], 'end', y.end + shift[k], 'value', y.value, 'left', y.left, 'right', y.right))))
        )[0])[0])[0])[0]))[0]"""


def located(pattern: str) -> Column:
    """Matches of a pattern in the column ``text`` as array of (start, end, value, left, right); code points, end exclusive.

    The text between matches and the matches themselves are taken apart. Their lengths are summed up in
    blocks of about the root of their number, since an array that grows is copied at each step.
    """
    return F.expr(LOCATED.format(pattern=pattern, span=SPAN, look=LOOK, before=BEFORE, after=AFTER)).cast(SPAN)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def fitting(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike(r"^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & passes_luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    need = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
    found = F.filter(located(PATTERNS[kind]), lambda x: fitting(kind, x["value"]))
    return F.when(need, found)


def located_identifiers(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` its doc_id, a row number, and the matches of each kind and of candidates, null if there are none to look for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    candidates = located(CANDIDATE)
    out = docs.select("doc_id", text.alias("text"))
    out = out.select("doc_id", *(_found(F.col("text"), k).alias(k) for k in KINDS), F.when(F.col("text").rlike(IDENTIFIER_LIKE), candidates).alias("candidates"))
    return out.withColumn("row", F.monotonically_increasing_id())


def patterns_at(left: Column, right: Column) -> Column:
    """The patterns of a match: its side and one to three words."""

    def of(side: str, text: Column, words: Callable[[Column, Column], Column]) -> Column:
        each = F.split(text, r"\s+")
        sized = F.transform(F.sequence(F.lit(1), F.size(each)), lambda n: F.concat(F.lit(side), F.array_join(words(each, n), " ")))
        return F.when(text != "", sized).otherwise(F.array().cast("array<string>"))

    return F.concat(of("<", left, lambda w, n: F.slice(w, -n, n)), of(">", right, lambda w, n: F.slice(w, F.lit(1), n)))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each of ``patterns`` (pattern) occur in all texts, whatever stands beside them."""
    wanted = materialize(patterns.select("pattern", F.substring("pattern", 2, 1 << 30).alias("gram")), "grams")
    firsts, grams = wanted.select(F.substring_index("gram", " ", 1).alias("w1")).distinct(), wanted.select("gram").distinct()
    if wanted.count() <= MOST_BROADCAST:
        firsts, grams = F.broadcast(firsts), F.broadcast(grams)
    w = F.split(F.lower("text"), r"\s+")
    rows = docs.where("text is not null").select(w.alias("w"))
    rows = rows.select(F.inline(F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), F.size("w")).alias("w2"), F.slice("w", F.lit(3), F.size("w")).alias("w3"))))
    rows = rows.join(firsts, "w1", "left_semi")
    each = rows.select(F.explode(F.array(F.col("w1"), F.concat("w1", F.lit(" "), "w2"), F.concat("w1", F.lit(" "), "w2", F.lit(" "), "w3"))).alias("gram"))
    counted = each.join(grams, "gram").groupBy("gram").agg(F.count("*").alias("total"))
    return wanted.join(counted, "gram", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def confident_patterns(docs: DataFrame, seeds: DataFrame, others: DataFrame) -> DataFrame:
    """(pattern, trust): the patterns of high confidence; ``seeds`` and ``others`` have value, left and right.

    A pattern needs SEEDS different seeds. Its trust is the belief in what stands at it, over its occurrences
    in all texts; plain words at it, which are never instances, count as unbelieved.
    """

    def edges(of: DataFrame) -> DataFrame:
        return of.select("value", F.explode(patterns_at(F.col("left"), F.col("right"))).alias("pattern"))

    known = edges(seeds).groupBy("pattern", "value").agg(F.count("*").alias("n"))
    known = materialize(known, "seed-edges")
    promising = materialize(known.groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SEEDS).select("pattern"), "promising")
    if not promising.limit(1).count():
        return promising.withColumn("trust", F.lit(0.0))
    totals = materialize(occurrences(docs, promising), "pattern-totals")
    more = edges(others).join(totals.select("pattern"), "pattern", "left_semi").groupBy("pattern", "value").agg(F.count("*").alias("n"))
    graph = known.select("pattern", "value", "n", F.lit(True).alias("seed")).unionByName(more.select("pattern", "value", "n", F.lit(False).alias("seed")))
    graph = graph.join(totals, "pattern").groupBy("pattern", "value", "total").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    graph = materialize(graph, "pattern-graph")

    def trusted(believed: DataFrame) -> DataFrame:
        """Of rows (pattern, total, n, belief), each pattern's trust."""
        return believed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.greatest(F.max("total"), F.sum("n"))).alias("trust"))

    patterns = materialize(trusted(graph.withColumn("belief", F.col("seed").cast("double"))), "patterns")
    for _ in range(ROUNDS):
        # an instance is unknown only so far as each of its patterns leaves it unknown
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))
        scored = graph.join(patterns, "pattern").groupBy("value").agg(F.max("seed").alias("is_seed"), (1 - doubt).alias("belief"))
        scored = scored.select("value", F.when(F.col("is_seed"), 1.0).otherwise(F.col("belief")).alias("belief"))
        patterns = materialize(trusted(graph.join(scored, "value")), "patterns")
    return patterns.where(F.col("trust") >= CONFIDENCE)


def apart(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """The spans ``others`` (row, start, end, ...) that overlap none of ``seeds`` in their row.

    Spans are sorted within their row, and each is held against the last end before it and the next start
    after it, which is linear in their number.
    """
    both = seeds.withColumn("own", F.lit(1)).unionByName(others.withColumn("own", F.lit(0)))
    before = Window.partitionBy("row").orderBy("start", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "own").rowsBetween(Window.unboundedPreceding, -1)
    ends, starts = F.when(F.col("own") == 1, F.col("end")), F.when(F.col("own") == 1, F.col("start"))
    marked = both.withColumn("ended", F.max(ends).over(before)).withColumn("next", F.min(starts).over(after))
    free = (F.col("own") == 0) & (F.coalesce("ended", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return marked.where(free).drop("own", "ended", "next")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) for each row of ``docs`` (doc_id, text).

    Spans are by kind as listed, those by context last, then by start; code points, end exclusive. One by
    context overlaps no other. A null or empty text has none. Null or repeated doc_ids stay; extra columns
    are left out.
    """
    base = materialize(located_identifiers(docs), "identifiers")
    own = F.concat(*(F.coalesce(F.col(k), F.array().cast(SPAN)) for k in KINDS))
    seeds = base.select("row", F.inline(own))
    others = base.where("candidates is not null").select("row", F.inline("candidates"))
    others = materialize(apart(seeds, others).where("left <> '' or right <> ''"), "candidates")
    patterns = materialize(confident_patterns(docs, seeds, others), "confident")
    at = others.select("row", "start", "end", F.explode(patterns_at(F.col("left"), F.col("right"))).alias("pattern"))
    more = at.join(patterns, "pattern", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("more"))

    def spans(kind: str, of: Column) -> Column:
        return F.transform(of, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    all_ = F.concat(*(F.coalesce(spans(k, F.col(k)), empty) for k in KINDS), F.coalesce(spans(CONTEXT, F.col("more")), empty))
    return base.join(more, "row", "left").select("doc_id", all_.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the kinds found by form, SHA-256 of their spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(of(*KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

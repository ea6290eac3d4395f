"""Text cut off by field limits (problem 9).

Two kinds of evidence are put together for every text. The histograms of its source's
lengths in characters and in bytes show spikes where a field limit cuts texts, and every
text is held against them. And its end says whether it stops at the end of a sentence, in a
structure that is still open, in a list, at a closing line, or in the middle. A text at a
spike is cut unless it ends in terminal punctuation or a whole closing line. Most texts
stand at no spike, since sources also cut at words, in transfer or at limits that few texts
reach; of these, ends that are open by themselves are cut, those with a mark in brackets
for the rest, and lists of which no other text knows the last term whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import cut

#: Parameters of a spike: lengths within NEAR count as neighbours; a spike has at least
#: LEAST different texts and TIMES as many as its neighbours have on average.
NEAR, LEAST, TIMES = 25, 4, 8.0
#: Parameter: a spike is at the maximum if at most this share of a source's texts is longer.
BEYOND = 0.005
#: Parameter: bytes that a cut at a byte limit may lose or gain in the last character.
BELOW, ABOVE = 3, 2

# The ends that texts have by nature.
STOPS = r"[.?!。？！]"
CLOSERS = r"[\"”»’')\]]*"
MARKS = r"(?:\.\.\.|…)"
#: Marks in brackets say by themselves that the rest is missing; a bare ellipsis may be natural.
EXPLICIT = rf"(?:\[(?:{MARKS}|truncated|cut)\]|\((?:{MARKS}|truncated|more)\))\s*$"
REPLACED = rf"{MARKS}\s*$"
SENTENCE = rf"{STOPS}{CLOSERS}$"
ABBREVIATION = r"(?:^|\W)(?:et al|e\.g|i\.e|cf|vs|pp?|[Ff]igs?|[Nn]o|[Vv]ol|[Ee]ds?)\.$"
LIST_HEAD = r"(?i)(?:keywords|key words|index terms|subject terms|schlagwörter|mots[- ]clés|palabras clave|ключевые слова|关键词)\s*[:：—–-]\s*"
CLOSING_LINES = [
    r"(?:Received|Accepted|Revised|Published)(?: on)? \d{1,2} \p{L}+ \d{4}$",
    r"© ?\d{4} (?:The Authors|All rights reserved)$",
    r"[—–-] ?(?:Curated|Compiled|Edited|Prepared) by .+ (?:group|team|board|library|archive|office|committee|project)$",
]
#: White space and invisible characters that may stand after a text.
AFTER_TEXT = " \t\n\v\f\r\x85\xa0\xad\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, [*range(0x2000, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065)]))
#: A remark in parentheses or an address after a full sentence.
AFTER_SENTENCE = rf"{STOPS}{CLOSERS}\s+(?:\([^()]{{2,60}}\)|https?://\S+[\p{{L}}\p{{N}}/])$"
#: An address after a full sentence, which may be cut inside.
ADDRESS = rf"{STOPS}{CLOSERS}\s+https?://\S+[\p{{L}}\p{{N}}/]$"


def _body(text: Column) -> Column:
    """The text without white space, invisible characters or line ends after it."""
    return F.rtrim(text, F.lit(AFTER_TEXT))


def _count(body: Column, char: str) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit(char), F.lit("")))


def with_endings(texts: DataFrame, text: str) -> DataFrame:
    """`texts` with columns kind and term for the end of each text.

    kind is 'sentence', 'closing', 'address' (or the doi of an only reference), 'list' (term: its last term), 'explicit' (a mark in brackets
    stands for the rest), 'mark' (the end is a bare ellipsis), 'structure' (an open one) or
    'open'.
    """
    # Two projections, so that the body of a text is found once and not for every test.
    texts = texts.withColumn("_body", _body(F.col(text))).withColumn("_last", F.substring_index("_body", "\n", -1))
    body, last = F.col("_body"), F.col("_last")
    tail = F.regexp_extract(last, LIST_HEAD + r"([^:：]*)$", 1)
    item = F.regexp_extract(last, r"^[-*•] ([^.?!。:;]*)$", 1)
    term = F.trim(F.when(item != "", item).otherwise(F.element_at(F.split(tail, "[;；]"), -1)))
    term = F.when(term.rlike(STOPS + "$"), F.lit("")).otherwise(term)
    bib = body.rlike(r"^\s*@\p{L}+\{")
    reference = last.rlike(r"^\[\d+\] ")
    dois = F.regexp_extract_all(body, F.lit(r"(?m)^\[\d+\] .*(doi:\S+)$"), F.lit(1))
    # Of several references the last address is as long as the shortest other one, if it is whole.
    others = F.array_min(F.transform(F.slice(dois, 1, F.greatest(F.size(dois) - 1, F.lit(0))), lambda x: F.length(x)))
    whole = last.rlike(r"doi:\S+$") & F.coalesce(F.length(F.element_at(dois, -1)) >= others, F.lit(True))
    kind = (
        F.when(bib & (_count(body, "{") > _count(body, "}")), "structure")
        .when(_count(body, "```") % 6 == 3, "structure")
        .when(last.rlike(r"\([^()]*$"), "structure")
        .when(reference & whole & (F.size(dois) == 1), "address")
        .when(reference & whole, "closing")
        .when(reference & (F.size(dois) > 0), "structure")
        .when(bib & body.endswith("}"), "closing")
        .when(last.rlike(EXPLICIT), "explicit")
        .when(last.rlike(REPLACED), "mark")
        .when(last.rlike(ABBREVIATION), "open")
        .when(last.rlike(SENTENCE), "sentence")
        .when(last.rlike("(?:" + "|".join(CLOSING_LINES) + ")"), "closing")
        .when(last.rlike(ADDRESS), "address")
        .when(last.rlike(AFTER_SENTENCE), "closing")
        .otherwise("open")
    )
    # Only ends that nothing else explains are read as lists.
    found = texts.withColumn("_kind", kind).withColumn("term", F.when(F.col("_kind") == "open", F.lower(term)))
    return found.withColumn("kind", F.when(F.col("term") != "", "list").otherwise(F.col("_kind"))).drop("_body", "_last", "_kind")


def inner_terms(text: Column) -> Column:
    """The list terms of a body that stand before another one, in lower case."""
    nothing = F.array().cast("array<string>")
    but_last = lambda t: F.slice(F.split(t, "[;；]"), 1, F.greatest(F.size(F.split(t, "[;；]")) - 1, F.lit(0)))
    tails = F.regexp_extract_all(text, F.lit(r"(?m)" + LIST_HEAD + r"([^:：\n]*)$"), F.lit(1))
    # Most texts have no list at all, which a plain search for its separator tells.
    inline = F.when(text.contains(";") | text.contains("；"), F.flatten(F.transform(tails, but_last))).otherwise(nothing)
    items = F.when(text.contains("\n"), F.regexp_extract_all(text, F.lit(r"(?m)^[-*•] ([^\n]*)(?=\n)"), F.lit(1))).otherwise(nothing)
    return F.array_distinct(F.transform(F.concat(inline, items), lambda x: F.lower(F.trim(x))))


def length_spikes(sized: DataFrame) -> DataFrame:
    """(source, unit, size): maximal lengths at which a source's histogram of different texts spikes.

    sized: source, chars, bytes and text_hash. Repeated texts count once.
    """
    cells = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    distinct = sized.select("source", "text_hash", "chars", "bytes").distinct()
    hist = distinct.select("source", F.inline(cells)).groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source", "unit")
    near = F.sum("n").over(own.orderBy("size").rangeBetween(-NEAR, NEAR)) - F.col("n")
    beyond = F.sum("n").over(own.orderBy(F.desc("size"))) - F.col("n")
    hist = hist.select("*", near.alias("near"), beyond.alias("beyond"), F.sum("n").over(own).alias("all"))
    spiked = (F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.col("near") / (2 * NEAR)) & (F.col("beyond") <= BEYOND * F.col("all") + F.when(F.col("unit") == "bytes", ABOVE).otherwise(0))
    return hist.where(spiked).select("source", "unit", "size")


def flag_truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, limit_chars, limit_bytes, at_limit, truncated) of each text that
    isn't null or blank; the limits are the spikes of its source at which the text stands.

    Sources are compared without case and outer blanks; a text of no source is held
    against the limits of all sources. Texts stay in the scan: only their length, hash and
    kind of end are shuffled.
    """
    texts = documents.select("doc_id", "source", "text").where(_body(F.coalesce("text", F.lit(""))) != "")
    sized = with_endings(texts, "text").select(
        "doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text_hash"), "kind", "term", inner_terms(_body(F.col("text"))).alias("inner"),
    )
    sized = cut(sized)  # what the texts tell is found once
    spikes = cut(length_spikes(sized))
    spikes = spikes.union(spikes.select(F.lit("").alias("source"), "unit", "size")).distinct()
    around = F.when(F.col("unit") == "bytes", F.sequence(F.col("size") - BELOW, F.col("size") + ABOVE)).otherwise(F.array("size"))
    limits = cut(spikes.select("source", "unit", F.explode(around).alias("at"), "size").groupBy("source", "unit", "at").agg(F.max("size").alias("size")))
    of = lambda unit, limit: limits.where(F.col("unit") == unit).select("source", F.col("at").alias(unit), F.col("size").alias(limit))
    held = sized.drop("inner").join(of("chars", "limit_chars"), ["source", "chars"], "left").join(of("bytes", "limit_bytes"), ["source", "bytes"], "left")
    held = held.withColumn("at_limit", F.col("limit_chars").isNotNull() | F.col("limit_bytes").isNotNull())
    known = sized.select(F.explode("inner").alias("term")).where("term <> ''").distinct().withColumn("_known", F.lit(True))
    lists = held.where("kind = 'list'").join(known, "term", "left")
    rest = held.where("kind <> 'list'").withColumn("_known", F.lit(True))
    whole = F.col("kind").isin("sentence", "closing")
    flagged = (F.col("at_limit") & ~whole) | F.col("kind").isin("open", "structure", "explicit") | F.col("_known").isNull()
    return rest.unionByName(lists).select("doc_id", "source", "kind", "limit_chars", "limit_bytes", "at_limit", flagged.alias("truncated"))


def truncation_rates(flagged: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate) over the texts of each source."""
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated")).withColumn("rate", F.col("truncated") / F.col("documents"))

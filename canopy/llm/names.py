"""Variant spellings of names typed by people (problem 1).

Names are parsed into tokens, and names that differ only in case, accents, particles or
order become one class. Blocking is MinHash banding over padded q-grams: of the leading
surname token for authors, of the shortened significant words (within equal initials) and
of the whole words for venues and publishers. Rows and bands are chosen from the collision
curve. What one slip takes out of all bands, as in short names, meets by the letters that
are left. Authors of near surnames meet by keys of their given names. Candidate classes are
verified by Monge-Elkan similarity, and the verified graph is clustered by
stars: a class with the most neighbours becomes a centre and its neighbours join it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import cut, ship

# Particles of surnames.
PARTICLES = {"de", "la", "von", "van", "der", "den", "del", "della", "di", "da", "dos", "le", "du", "ter", "zu", "af", "al", "el", "bin", "ibn"}
# Short forms of given names and the full forms they stand for, without accents.
SHORT_FORMS = {
    "charlie": "charles", "chuck": "charles", "vale": "valentina", "tina": "valentina christina", "roz": "rosalind", "ros": "rosalind", "leo": "leonardo leonard", "leon": "leonardo", "vicky": "victoria", "vicki": "victoria", "tori": "victoria",
    "willi": "wilhelm", "willy": "wilhelm william", "helm": "wilhelm", "tom": "thomas", "tommy": "thomas", "mike": "michael", "mick": "michael", "mickey": "michael", "isa": "isabella isabel", "bella": "isabella", "fred": "frederick alfred", "freddy": "frederick", "freddie": "frederick", "fritz": "frederick friedrich",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "sue": "susan", "susie": "susan", "suzy": "susan", "kathy": "katherine", "kate": "katherine", "katie": "katherine", "kit": "katherine", "kay": "katherine",
    "dan": "daniel", "danny": "daniel", "rick": "richard", "ricky": "richard", "rich": "richard", "dick": "richard", "gwen": "gwendolyn", "wendy": "gwendolyn", "lola": "dolores", "loli": "dolores", "chris": "christopher christina", "kris": "christopher", "topher": "christopher", "joe": "joseph", "joey": "joseph", "jo": "joseph josephine",
    "dima": "dmitri", "mitya": "dmitri", "eddie": "edward", "ed": "edward", "ted": "edward theodore", "teddy": "edward theodore", "ned": "edward", "paco": "francisco", "pancho": "francisco", "frank": "francisco francis", "curro": "francisco", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "klaus": "nicholas",
    "alex": "alexander", "sasha": "alexander", "al": "alexander albert", "sandy": "alexander", "bill": "william", "billy": "william", "will": "william", "liam": "william", "hannes": "johannes", "hans": "johannes", "jan": "johannes", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert",
    "katya": "ekaterina", "katja": "ekaterina", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "peg": "margaret", "marge": "margaret", "seun": "oluwaseun", "olu": "oluwaseun", "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "jenny": "jennifer", "jen": "jennifer", "jenn": "jennifer",
    "pepe": "jose", "pepito": "jose", "olya": "olga", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "tony": "anthony", "steve": "steven stephen", "dave": "david", "matt": "matthew", "andy": "andrew", "sam": "samuel", "max": "maximilian", "greg": "gregory", "tim": "timothy", "jeff": "jeffrey", "nate": "nathaniel", "abby": "abigail", "becky": "rebecca", "debbie": "deborah", "gabi": "gabriele", "lena": "helena", "nina": "antonina", "masha": "maria", "misha": "mikhail", "volodya": "vladimir", "kolya": "nikolai", "vanya": "ivan", "lucho": "luis", "nacho": "ignacio", "quique": "enrique", "toni": "antonia",
}
# Words that carry no name, legal forms and trades, and short forms no prefix of their word.
SMALL_WORDS = {"of", "the", "in", "on", "and", "for", "de", "la", "und", "et", "y", "online", "print"}
LEGAL_FORMS = {"publishing", "publishers", "publisher", "publ", "gmbh", "sa", "ltd", "limited", "inc", "llc", "ag", "bv", "plc", "co", "kg", "srl", "spa"}
WORD_FORMS = {"up": "university press", "eds": "editions", "pr": "press", "univ": "university", "jnl": "journal", "jrnl": "journal", "pubs": "publ", "pub": "publ", "trs": "transactions", "intl": "international", "dept": "department", "assoc": "association"}

#: Parameters: q of the q-grams, hash functions of a signature, letters of a word that
#: blocking looks at, and (similarity, recall) that the bands are tuned for: the lowest
#: q-gram similarity of a pair that differs by one slip, and the share to be found there.
#: "stems" are shortened words that agree in all initials, "words" whole words.
Q, HASHES, STEM = 3, 180, 4
TUNED = {"author": (0.43, 0.99), "stems": (0.55, 0.97), "words": (0.78, 0.95)}
#: Parameters: the slips allowed in a token and the least Monge-Elkan similarity of a match.
SLIPS, MATCH = 1, 0.75


def tuned_bands(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the most selective bands on whose curve 1 - (1 - s^r)^b a pair of the
    given similarity still collides with the given probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return rows, bands
    return 1, hashes


def fold(text: str) -> str:
    """Lower case without accents."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return text.replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")


#: The short forms in folded letters.
FORMAL = {fold(k): " ".join(map(fold, v.split())) for k, v in SHORT_FORMS.items()}
_DOTTED = re.compile(r"^(?:[^\W\d_]\.?-?)*[^\W\d_]\.$|^[^\W\d_]$")


def _initials(token: str) -> list[str]:
    return [fold(c)[0] for c in token if c.isalpha()]


def _given(tokens: list[str]) -> tuple[str, str]:
    """(full given name or '', initials): of 'Jean-Pierre T.' the name and 'jpt', of 'J.-P. T.' '' and 'jpt'."""
    inits: list[str] = []
    full = ""
    for i, t in enumerate(tokens):
        if _DOTTED.match(t) or (i and len(t.rstrip(".")) == 1):
            inits += _initials(t)
        else:
            own = fold(t).strip(".")
            if i == 0:
                full = own
            inits += [p[0] for p in re.split(r"[-’']", FORMAL.get(own, own).split()[0]) if p]
    return full, "".join(inits)


def _surname(tokens: list[str]) -> list[str]:
    parts = [p for t in tokens for p in re.split(r"[-‐]", fold(t).strip(".,")) if p]
    return [p for p in parts if p not in PARTICLES] or parts


def parse_author(name: str) -> list[tuple[str, list[str], str, str]]:
    """[(certainty, surname tokens, given name, initials)]: one reading, or two where a name
    of two bare parts doesn't show which one is the surname. Nothing for names without letters."""
    name = " ".join(name.split())
    if not any(c.isalpha() for c in name):
        return []
    if "," in name:
        left, right = (x.split() for x in name.split(",", 1))
        right = [t.strip(",") for t in right]
        given = [t for t in right if t and t.lower() not in PARTICLES]
        if left:
            return [("sure", _surname(left), *_given(given))]
        tokens = given
    else:
        tokens = name.split()
    small = [t.lower() in PARTICLES for t in tokens]
    if len(tokens) == 1:
        return [("sure", _surname(tokens), "", "")]
    last = tokens[-1]
    if len(last) <= 3 and last.isalpha() and last.isupper() and not small[-1] and not name.isupper():
        return [("sure", _surname(tokens[:-1]), "", "".join(_initials(last)))]
    if _DOTTED.match(tokens[0]):
        cut_ = next((i for i, t in enumerate(tokens) if not _DOTTED.match(t)), 1)
        return [("sure", _surname(tokens[cut_:]), *_given(tokens[:cut_]))]
    if _DOTTED.match(last):
        cut_ = next(i for i in range(len(tokens)) if all(map(_DOTTED.match, tokens[i:])))
        return [("sure", _surname(tokens[:cut_]), *_given(tokens[cut_:]))]
    if small[0]:
        start = small.index(False) if False in small else len(tokens) - 1
        return [("sure", _surname(tokens[: start + 1]), *_given(tokens[start + 1 :]))]
    if any(small):
        at = small.index(True)
        return [("sure", _surname(tokens[at:]), *_given(tokens[:at]))]
    return [("last", _surname(tokens[-1:]), *_given(tokens[:-1])), ("first", _surname(tokens[:1]), *_given(tokens[1:]))]


def parse_title(name: str) -> list[str]:
    """The significant words of a venue or publisher, folded, in order of the alphabet."""
    words = re.findall(r"[^\W_]+(?:\.[^\W_](?=\.|$|\W))*", fold(name))
    words = [x for w in words for x in WORD_FORMS.get(w.replace(".", ""), w.replace(".", "")).split()]
    kept = []
    for i, w in enumerate(words):
        small = w in SMALL_WORDS or w in LEGAL_FORMS or (i and any(_one_slip(w, s) and (len(w) <= 3 or set(w) == set(s)) for s in ("of", "in", "on", "and", "the")))
        if not small:
            kept.append(w)
    # Spaced-out legal forms such as "S. A."
    kept = [w for w in kept if len(w) > 1 or w in ("j", "q", "z")] or kept
    return sorted(kept or words)


def _one_slip(a: str, b: str) -> bool:
    """True if one insertion, deletion, replacement or swap of neighbours makes a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def grams(tokens: list[str], q: int = Q, stem: int | None = None) -> set[str]:
    """Padded q-grams of each token: q - 1 pads before it, one after it unless it is shortened."""
    out = set()
    for t in tokens:
        padded = "#" * (q - 1) + (t[:stem] if stem else t + "#")
        out |= {padded[i : i + q] for i in range(len(padded) - q + 1)} or {padded}
    return out


class Signer:
    """MinHash band keys of gram sets."""

    def __init__(self, rows: int, bands: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.a = rng.integers(1, 2**31 - 1, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**31 - 1, rows * bands, dtype=np.uint64)

    def keys(self, gram_set: set[str]) -> list[int]:
        h = np.array([int.from_bytes(_digest(g), "little") for g in sorted(gram_set)], np.uint64)[:, None]
        with np.errstate(over="ignore"):
            mixed = (h * self.a + self.b) ^ ((h * self.a + self.b) >> np.uint64(29))
            least = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0).reshape(self.bands, self.rows)
            key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for r in range(self.rows):
                key = (key ^ least[:, r]) * np.uint64(0x100000001B3)
                key ^= key >> np.uint64(31)
        return key.astype(np.int64).tolist()


def _digest(gram: str) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(gram.encode())


def slip_keys(tokens: list[str]) -> list[int]:
    """Keys of which two lists share one if they differ by one slip in one token, however short.

    Tokens one slip apart (also a swap of neighbours) are equal after at most one letter is
    left out of each. The other tokens stand by their first letters.
    """
    keys = set()
    for i, t in enumerate(tokens):
        others = sorted(x[:STEM] for x in tokens[:i] + tokens[i + 1 :])
        near = {t, *(t[:k] + t[k + 1 :] for k in range(len(t)))} - {""}
        keys |= {int.from_bytes(_digest("\n".join([x, "", *others])), "little", signed=True) for x in near}
    return sorted(keys)


READING = "name_id long, kind string, certainty string, tokens array<string>, given string, inits string"


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, kind, name in zip(*(c.to_pylist() for c in b.columns)):
            if kind == "author":
                rows += [(i, kind, *r) for r in parse_author(name)]
            elif words := parse_title(name):
                rows.append((i, kind, "sure", words, "", ""))
        schema = pa.schema([("name_id", pa.int64()), ("kind", pa.string()), ("certainty", pa.string()), ("tokens", pa.list_(pa.string())), ("given", pa.string()), ("inits", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)], schema=schema)


def read_names(names: DataFrame) -> DataFrame:
    """One reading of each name: name_id, kind, tokens, given, inits.

    Which of two bare parts is the surname is decided by how often the sure readings of all
    names use either token as a surname or as a given name (at a tie, the last part).
    """
    ship(names.sparkSession)
    chosen = names.where("name is not null and kind is not null").select(F.col("name_id").cast("long"), F.col("kind").cast("string"), F.col("name").cast("string"))
    read = chosen.mapInArrow(_readings, READING)
    sure = read.where("certainty = 'sure' and kind = 'author'")
    uses = sure.select(F.explode("tokens").alias("word"), F.lit(1).alias("s"), F.lit(0).alias("g")).union(sure.where("given <> ''").select("given", F.lit(0), F.lit(1)))
    roles = uses.groupBy("word").agg(((F.sum("s") - F.sum("g")) / (F.sum("s") + F.sum("g") + 1)).alias("surness"))
    unsure = read.where("certainty <> 'sure'").withColumn("lead", F.col("tokens")[0])
    scored = unsure.join(roles.withColumnRenamed("word", "lead"), "lead", "left").withColumnRenamed("surness", "ss").join(roles.withColumnRenamed("word", "given"), "given", "left")
    score = F.coalesce("ss", F.lit(0.0)) - F.coalesce("surness", F.lit(0.0))
    best = scored.groupBy("name_id", "kind").agg(F.max(F.struct(score.alias("score"), (F.col("certainty") == "last").alias("is_last"), "tokens", "given", "inits")).alias("b"))
    return read.where("certainty = 'sure'").drop("certainty").unionByName(best.select("name_id", "kind", "b.tokens", "b.given", "b.inits"))


def name_classes(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): names with equal readings share a class, called by its smallest name_id.

    members: name_id, class. classes: class, kind, tokens, given, inits, size.
    """
    same = ["kind", "tokens", "given", "inits"]
    classes = readings.groupBy(*same).agg(F.min("name_id").alias("class"), F.count(F.lit(1)).alias("size"))
    members = readings.join(classes, same).select("name_id", "class")
    return members, classes


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signers = {name: Signer(*tuned_bands(*TUNED[name]), seed=11 + i) for i, name in enumerate(TUNED)}
    for b in batches:
        block, key = [], []
        for i, kind, tokens in zip(*(c.to_pylist() for c in b.columns)):
            if kind == "author":
                keys = signers["author"].keys(grams(tokens))
            else:
                salt = int.from_bytes(_digest("".join(sorted(t[0] for t in tokens)))[:7], "little")
                keys = [k ^ salt for k in signers["stems"].keys(grams(tokens, stem=STEM))] + signers["words"].keys(grams(tokens))
            keys += slip_keys(tokens)
            block += [i] * len(keys)
            key += keys
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(key, pa.int64())], names=["block", "band"])


def given_keys(given: str, inits: str) -> tuple[set[str], set[str]]:
    """(keys that a class asks for, keys under which it is found) of a given name and initials.

    Two classes share a key if one's initials begin with the other's and at most one has a
    full given name, or if both have and the names (or the names they are short for) are one
    slip apart and the initials behind them begin alike. A class without initials only
    meets others without.
    """
    starts = lambda x: [x[:k] for k in range(len(x) + 1)]
    if not given:
        asked, found = {f"a {inits}"}, {f"{side} {p}" for side in "ai" for p in (starts(inits)[1:] if inits else [""])}
        return asked, found
    forms = {re.sub("[-’']", "", f) for f in FORMAL.get(given, given).split()}
    near = {f[:k] + f[k + 1 :] for f in forms for k in range(len(f))} | forms
    asked = {f"i {inits}"} | {f"g {x} {inits[1:]}" for x in near}
    found = {f"a {p}" for p in starts(inits)[1:]} | {f"g {x} {p}" for x in near for p in starts(inits[1:])}
    return asked, found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = ([], [], [], [])
        for i, block, given, inits in zip(*(c.to_pylist() for c in b.columns)):
            for asks, keys in zip((True, False), given_keys(given, inits)):
                for key in sorted(keys):
                    for column, x in zip(out, (i, block, asks, int.from_bytes(_digest(key), "little", signed=True))):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["class", "block", "asks", "key"])


def near_blocks(blocks: DataFrame) -> DataFrame:
    """(block, other), block < other: blocks of one kind that collide in a band or are one slip
    apart; of authors those whose leading surname tokens match."""
    bands = blocks.select("block", "kind", "seen").mapInArrow(_signed, "block long, band long")
    keyed = bands.join(blocks.select("block", "kind"), "block").select("block", F.xxhash64("band", "kind").alias("key"))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keyed = keyed.join(many, "key")
    near = keyed.join(keyed.select("key", F.col("block").alias("other")), "key").where("block < other").select("block", "other").distinct()
    side = lambda c, to: blocks.select(F.col("block").alias(c), "kind", F.col("seen").alias(to)) if c == "block" else blocks.select(F.col("block").alias(c), F.col("seen").alias(to))
    both = near.join(side("block", "x"), "block").join(side("other", "y"), "other")
    return both.where((F.col("kind") != "author") | (_token_similarity(F.col("x")[0], F.col("y")[0]) > 0)).select("block", "other")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: classes of one kind that may match.

    A block is what blocking sees of a class: for authors the leading surname token, else
    the words. Bands are computed and paired between different blocks, and only blocks that
    are near go on. Classes of near blocks (and of one) meet by the keys of their given
    names, never all with all: a surname that a third of all names bears gives the pairs
    whose given names agree.
    """
    seen = F.when(F.col("kind") == "author", F.slice("tokens", 1, 1)).otherwise(F.col("tokens"))
    blocked = classes.select("class", "kind", seen.alias("seen"), "given", "inits").withColumn("block", F.xxhash64("kind", "seen"))
    blocks = cut(blocked.select("block", "kind", "seen").distinct())
    near = cut(near_blocks(blocks))
    keys = cut(blocked.select("class", "block", "given", "inits").mapInArrow(_met, "class long, block long, asks boolean, key long"))
    asked, found = keys.where("asks").select("class", "block", "key"), keys.where("not asks").select(F.col("class").alias("class2"), F.col("block").alias("other"), "key")
    both = near.union(near.select("other", "block"))
    own = asked.join(found.withColumnRenamed("other", "block"), ["block", "key"]).select("class", "class2")
    across = both.join(asked, "block").join(found, ["other", "key"]).select("class", "class2")
    return own.union(across).where("class <> class2").select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct()


def _token_similarity(x: Column, y: Column) -> Column:
    """1 for equal tokens, less by the share of letters slipped, 0 beyond SLIPS slips.

    A slip is an insertion, a deletion, a replacement or a swap of neighbours. Letters
    written as two (oe, ue, ae, aa) may also be compared as one.
    """
    edits = F.levenshtein(x, y)
    letters = lambda z: F.array_join(F.array_sort(F.split(z, "")), "")
    single = lambda z: F.regexp_replace(F.replace(z, F.lit("aa"), F.lit("a")), "([oua])e", "$1")
    slips = (
        F.when(edits <= SLIPS, edits)
        .when((edits == 2) & (F.length(x) == F.length(y)) & (letters(x) == letters(y)), 1)
        .when(edits <= 2 * SLIPS + 2, F.levenshtein(single(x), single(y)))
        .otherwise(edits)
    )
    return F.when(slips <= SLIPS, 1 - slips / F.greatest(F.length(x), F.length(y))).otherwise(F.lit(0.0))


def _shortened(x: Column, y: Column) -> Column:
    return F.when(F.startswith(x, y) | F.startswith(y, x), F.lit(1.0)).otherwise(_token_similarity(x, y))


def monge_elkan(a: Column, b: Column, similarity) -> tuple[Column, Column]:
    """(mean, least) over the tokens of the shorter list of the best similarity in the longer one."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    best = F.transform(short, lambda x: F.array_max(F.transform(long, lambda y: similarity(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(short), F.lit(1)), F.array_min(best)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, score): the candidate pairs that match by Monge-Elkan similarity.

    Authors: the surname tokens match, the leading ones with each other (a double surname
    may have lost its second part); full given names match by similarity or as short form;
    the initials of one don't contradict the other's. Others: as many words in both, each
    with a match, where a word may be shortened.
    """
    side = lambda p: classes.select(F.col("class").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("tokens", "given", "inits")])
    both = pairs.join(side("a"), "a").join(side("b").join(classes.select(F.col("class").alias("b"), "kind"), "b"), "b")
    ta, tb, ga, gb, ia, ib = (F.col(x) for x in ("tokens_a", "tokens_b", "given_a", "given_b", "inits_a", "inits_b"))
    mean, least = monge_elkan(ta, tb, _token_similarity)
    lead = _token_similarity(ta[0], tb[0]) > 0
    table = F.create_map(*[F.lit(x) for k, v in FORMAL.items() for x in (k, v)])
    forms = lambda g: F.split(F.coalesce(F.try_element_at(table, g), g), " ")
    bare = lambda g: F.regexp_replace(g, "[-’']", "")
    full = (ga != "") & (gb != "")
    alike = F.arrays_overlap(forms(ga), forms(gb)) | (F.array_max(F.transform(forms(ga), lambda x: F.array_max(F.transform(forms(gb), lambda y: _token_similarity(bare(x), bare(y)))))) > 0)
    given = F.when(full, alike).otherwise(F.lit(True))
    # Behind a full given name on both sides the initials that follow it decide, so that a slip in the name doesn't.
    rest = lambda i: F.substr(i, F.lit(2))
    ra, rb = F.when(full, rest(ia)).otherwise(ia), F.when(full, rest(ib)).otherwise(ib)
    initials = F.startswith(ra, rb) | F.startswith(rb, ra)
    author = lead & (least > 0) & (mean >= MATCH) & given & initials
    wmean, wleast = monge_elkan(ta, tb, _shortened)
    other, oleast = monge_elkan(tb, ta, _shortened)
    words = (F.size(ta) == F.size(tb)) & (wleast > 0) & (oleast > 0) & (wmean >= MATCH) & (other >= MATCH)
    ok = F.when(F.col("kind") == "author", author).otherwise(words)
    score = F.when(F.col("kind") == "author", mean + F.when(full & (ga == gb), 0.2).otherwise(0.0)).otherwise(wmean + F.when(ta == tb, 0.2).otherwise(0.0))
    return both.where(ok).select("a", "b", score.alias("score"))


def star_clusters(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(class, centre): stars over the edges (a, b, score); weights: class, size.

    In every round each free class that comes before all its free neighbours (more names
    in it and its neighbours, then the smaller class) becomes a centre, and each free
    neighbour of centres joins the one with the best score (then weight, then the smaller
    class). This gives the stars of the sequential method, since a centre depends on
    earlier classes in its neighbourhood only. Ends when no edge between free classes is
    left; classes without a star aren't returned.
    """
    both = edges.select("a", "b", "score").union(edges.select("b", "a", "score")).toDF("v", "n", "score")
    size = weights.select(F.col("class").alias("n"), "size")
    around = both.join(size, "n").select("v", "size").union(both.select("v").distinct().join(size.withColumnRenamed("n", "v"), "v").select("v", "size"))
    degree = around.groupBy("v").agg(F.sum("size").alias("d"))
    free = cut(both.join(degree, "v").join(degree.select(F.col("v").alias("n"), F.col("d").alias("dn")), "n"))
    found = []
    while True:
        before = F.struct((-F.col("dn")).alias("d"), F.col("n").alias("v")) < F.struct((-F.col("d")).alias("d"), F.col("v"))
        centres = free.groupBy("v").agg(F.max(before).alias("later")).where("not later").select("v")
        joined = free.join(centres.select(F.col("v").alias("n")), "n").groupBy("v").agg(F.max(F.struct("score", "dn", (-F.col("n")).alias("c"))).alias("b"))
        stars = cut(joined.select(F.col("v").alias("class"), (-F.col("b.c")).alias("centre")))
        if not stars.take(1):
            break
        found.append(stars)
        taken = stars.select("class").union(stars.select("centre")).distinct()
        free = cut(free.join(taken.withColumnRenamed("class", "v"), "v", "left_anti").join(taken.withColumnRenamed("class", "n"), "n", "left_anti"))
    if not found:
        return edges.select(F.col("a").alias("class"), F.col("b").alias("centre")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)


def link_names(names: DataFrame) -> DataFrame:
    """(name_id, entity): the entity of each name is the name_id of its star's centre class.

    names: name_id (unique), kind, name. Null names and kinds are left out, and so are
    names without letters; a name like no other is an entity of its own.
    """
    members, classes = name_classes(cut(read_names(names)))
    members, classes = cut(members), cut(classes)
    edges = cut(verified(candidates(classes), classes))
    stars = star_clusters(edges, classes)
    return members.join(stars, "class", "left").select("name_id", F.coalesce("centre", "class").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names of one entity."""
    many = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity")
    rows = linked.join(many, "entity")
    return rows.select("entity", F.col("name_id").alias("name_a")).join(rows.select("entity", F.col("name_id").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")

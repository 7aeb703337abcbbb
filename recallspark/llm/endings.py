"""Text cut off by field limits: near-copies that go on, and how closings end.

1. Every text is unwrapped (shells, labels, cut marks) and its sentences written in
   symbols that do not tell names and numbers apart; sentences of equal symbols are
   one class. The last sentence of an open-ended text is compared with near-copies
   among all sentences. Candidates come from min-hash banding over five-word
   shingles, taken over prefixes of growing length: the open sentence asks with its
   longest such prefix, and every sentence holds the bands of all of its own, so
   truncation does not hide a copy. A pair counts if the other sentence contains at
   least 0.8 of the open one's shingles. It is then aligned on the closing words. A
   text was cut where the copies go on behind its end and (next to) none ends.
2. Records without such a copy are scored by closing-word terminality: of all
   places in the corpus where the closing words (up to six, the longest context
   seen often enough) occur, the share where a sentence ends there. A closing
   word never seen whole, but the beginning of words that are, was cut inside.

Scale: context counts are pre-aggregated in each Arrow batch, keyed by a 64-bit
hash and held against a bit filter of the contexts that some record closes with.
The filter is sized by their number, 64 MB at most; what it lets through an exact
join drops. A class costs one row per task, however many records share it. Bands
travel as hashes and class ids, symbols are fetched for candidate pairs alone. No
list of records ever gathers in one task.

Defined results: NULL, blank and empty-shell texts are not cut; a text that only
repeats its question is not cut; repeated ids count once, the latest row standing;
rows without an id are dropped; further columns are not read; an empty table gives
no rows. One-sided ties (a context ending half of the time) count as whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.answers import has_letters, is_stop, unwrap, words
from recallspark.session import stash

LONGEST = 6
SHINGLE, BANDS, ROWS = 5, 8, 4
ALIKE = 0.8
#: A context must have been seen this often, the record itself not counted.
SEEN = 4
#: Least share of endings for a whole text: in a text with stops inside, and in one without.
LEAST_WITH_STOPS, LEAST_WITHOUT = 0.2, 0.03
#: Least share of near-copies that end where a whole text ends.
LEAST_COPIES = 0.03

SIDES = (
    "pq_id bigint, side string, run_name string, words array<string>, stop boolean, inner_stop boolean, comma boolean, "
    "broken boolean, marked boolean, unclosed boolean, copied boolean, empty boolean, last string, keys array<bigint>, found array<string>, class binary"
)
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def values(column: pa.Array) -> list:
    """A column as Python values; lists (never NULL here) are cut from one flat list, which is much faster than item by item."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def record_batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Hashes(dict):
    """64-bit hashes of symbols; a worker keeps the frequent ones."""

    def __missing__(self, x: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[x] = xxhash.xxh64_intdigest(x)
        return h


_SYMBOLS = _Hashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def symbol_hashes(symbols: list[str]) -> np.ndarray:
    return np.fromiter((_SYMBOLS[x] for x in symbols), np.uint64, len(symbols))


def run_hashes(h: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 1..longest symbols that end at each place (first places: too short to mean anything)."""
    runs = [h]
    for n in range(2, longest + 1):
        last = runs[-1]
        longer = last.copy()
        if n > len(h):
            runs.append(longer)
            continue
        # the run one shorter ending here, with the symbol before it mixed in
        longer[n - 1 :] = (last[n - 1 :] ^ (last[n - 1 :] >> np.uint64(29))) * _STEP + h[: len(h) - n + 1]
        runs.append(longer)
    return runs


def closing_keys(symbols: list[str], longest: int = LONGEST) -> list[int]:
    """As ``run_hashes`` at the last place alone, signed; as many as there are symbols."""
    h, keys = 0, []
    for x in symbols[: -longest - 1 : -1]:
        h = ((h ^ (h >> 29)) * int(_STEP) + _SYMBOLS[x]) & _MASK if keys else _SYMBOLS[x]
        keys.append(h - (1 << 64) if h >> 63 else h)
    return keys


def classes(tokens: list[str]) -> list[str]:
    """Tokens as context symbols: numbers and names inside a sentence are alike."""
    shout = all(t.upper() == t for t in tokens) and any(len(t) > 1 for t in tokens)
    single = sum(t[0].isalnum() for t in tokens) == 1
    out, first = ["^"], True
    for t in tokens:
        if not t[0].isalnum():
            out.append("." if is_stop(t) else t[0])
            first = is_stop(t)
            continue
        if t.isdigit():
            out.append("#")
        elif t[0].isupper() and not shout and (single or not first):
            out.append("<N>")
        else:
            out.append(t.lower())
        first = False
    return out


def masked(tokens: list[str]) -> list[str]:
    """Symbols of a whole text for comparing it with others: a capital at its start tells nothing."""
    symbols = classes(tokens)[1:]
    if tokens and tokens[0][0].isupper():
        symbols[0] = "<N>"
    return symbols


def is_word(symbol: str) -> bool:
    return symbol[0].isalnum() or symbol in ("<N>", "#")


def shingles(plain: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(plain[i:] for i in range(SHINGLE))))


_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)
#: Prefix lengths in shingles, each half again as long as the one before.
PREFIXES = [1]
while PREFIXES[-1] < 1 << 40:
    PREFIXES.append(PREFIXES[-1] * 3 // 2 + 1)


def band_keys(texts: list[list[str]]) -> list[list[int]]:
    """Min-hash bands of each text's prefixes, shortest first; none for texts under five words."""
    out: list[list[int]] = [[] for _ in texts]
    offset = np.arange(BANDS, dtype=np.uint64)
    for at in range(0, len(texts), 512):
        some = [i for i in range(at, min(at + 512, len(texts))) if len(texts[i]) >= SHINGLE]
        if not some:
            continue
        grams = [run_hashes(symbol_hashes(texts[i]), SHINGLE)[-1][SHINGLE - 1 :] for i in some]
        levels = [bisect_right(PREFIXES, len(g)) for g in grams]
        grams = [g[: PREFIXES[n - 1]] for g, n in zip(grams, levels)]
        starts, base = [], 0
        for g, n in zip(grams, levels):
            starts += [base + (PREFIXES[j - 1] if j else 0) for j in range(n)]
            base += len(g)
        low = np.minimum.reduceat((np.concatenate(grams)[:, None] | np.uint64(1)) * _A + _B, starts, axis=0)
        number = np.concatenate([np.arange(n) for n in levels])
        for j in range(1, max(levels)):  # a longer prefix holds the shorter ones
            deep = np.flatnonzero(number == j)
            low[deep] = np.minimum(low[deep], low[deep - 1])
        low = low.reshape(len(low), BANDS, ROWS)
        keys = low[:, :, 0]
        for r in range(1, ROWS):
            keys = (keys ^ (keys >> np.uint64(31))) * _STEP + low[:, :, r]
        keys = ((keys + offset) ^ (number.astype(np.uint64) << np.uint64(57))[:, None]).view(np.int64)
        base = 0
        for i, n in zip(some, levels):
            out[i] = keys[base : base + n].ravel().tolist()
            base += n
    return out


def prepare(pq_id: int, side: str, run: str | None, question: str | None, text: str | None, rules=None) -> list:
    """One side of a record as a row of ``SIDES``."""
    content = unwrap(text)
    tokens = list(words(content.text))
    plain = [t.lower() for t in tokens if t[0].isalnum()]
    end = len(tokens)
    stop = comma = False
    while end and not tokens[end - 1][0].isalnum():
        end -= 1
        mark = tokens[end]
        stop |= is_stop(mark)
        comma |= not stop and mark[0] in ",;:"
    body = tokens[:end]
    symbols = classes(body) if body else []
    asked = [w.lower() for w in words(question) if w[0].isalnum()] if question else []
    last = next((sentence for sentence, _ in reversed(sentences_of(tokens))), []) if side != "question" else []
    return [
        pq_id, side, run, tokens, stop, "." in symbols, comma,
        bool(text) and "�" in text[-3:], content.marked, content.unclosed,
        bool(plain) and bool(asked) and repeats(plain, asked), not has_letters(content.text), body[-1] if body else None,
        closing_keys(symbols),
        rules(question, content.text) if rules and side != "question" else [],
        class_of(masked(last)) if enough_words(last) else None,
    ]


def sentences_of(tokens: list[str]) -> list[tuple[list[str], bool]]:
    """The sentences without closing marks, and whether a stop closes each."""
    out, start = [], 0
    for i, t in enumerate(tokens):
        if is_stop(t):
            if i > start:
                out.append((tokens[start:i], True))
            start = i + 1
    if start < len(tokens):
        out.append((tokens[start:], False))
    return out


def enough_words(tokens: list[str]) -> bool:
    return len(tokens) >= SHINGLE and sum(t[0].isalnum() for t in tokens) >= SHINGLE


def class_of(symbols: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\0".join(symbols))


def repeats(plain: list[str], asked: list[str]) -> bool:
    """Whether the words are the question's, in whatever order, once or more."""
    a, b = Counter(plain), Counter(asked)
    if set(a) - set(b):
        return False
    return sum(min(a[w], b[w]) for w in b) >= 0.8 * len(asked)


def place_endings(texts: list[tuple[str, list[str]]], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[str]]:
    """Contexts of all places of the texts (side, tokens): hash, ends, total; and the words seen whole.

    ``wanted`` is a bit filter of the contexts that some record closes with.
    """
    symbols: list[str] = []
    place, ends, known = [], [], []
    whole: set[str] = set()
    for side, tokens in texts:
        n = len(tokens)
        symbols += classes(tokens)
        place.append(np.arange(n + 1))
        end, know = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        for i, t in enumerate(tokens):
            if not t[0].isalnum():
                continue
            after = tokens[i + 1] if i + 1 < n else None
            if after is None:
                end[i + 1], know[i + 1] = 1, side == "gold"
            else:
                end[i + 1], know[i + 1] = is_stop(after), True
                if after[0].isalnum() or i + 2 < n:
                    whole.add(t.lower())
        ends.append(end)
        known.append(know)
    if not symbols:
        none = np.zeros(0, np.int64)
        return none, none, none, whole
    at, end, know = np.concatenate(place), np.concatenate(ends), np.concatenate(known)
    keys, flags = [], []
    for n, h in enumerate(run_hashes(symbol_hashes(symbols), LONGEST), 1):
        use = know & (at >= n - 1)
        if wanted is not None:
            use &= in_filter(wanted, h)
        keys.append(h[use])
        flags.append(end[use])
    distinct, where = np.unique(np.concatenate(keys).view(np.int64), return_inverse=True)
    total = np.bincount(where, minlength=len(distinct))
    return distinct, np.bincount(where, weights=np.concatenate(flags), minlength=len(distinct)).astype(np.int64), total, whole


#: The filter of wanted contexts has 8 bits for each, but 2 ** 29 (64 MB) at most.
MOST_BITS = 29


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has the hashes; false hits cost a row that a join drops."""
    bit = h.view(np.uint64) >> np.uint64(64 - 6 - (len(words).bit_length() - 1))
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def wanted_filter(sides: DataFrame) -> np.ndarray:
    """Bit filter of all closing contexts, made by a distributed bitwise or."""
    keys = sides.where(F.col("side") != "question").select(F.explode("keys").alias("key"))
    many = keys.agg(F.approx_count_distinct("key")).first()[0]
    bits = min(max((8 * many).bit_length(), 12), MOST_BITS)
    masks = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit")).select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("m"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    found = masks.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return words


def sides_of(records: DataFrame, rules: Callable[[str | None, str], list[str]] | None = None) -> DataFrame:
    """Each id's latest row as prepared sides: question, gold and prediction.

    ``rules`` are asked in the same pass what they find in a side's bare text (``found``).
    """
    cols = ["run_name", "sample", "question", "gold", "prediction"]
    latest = records.where(F.col("pq_id").isNotNull()).groupBy("pq_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r"))

    schema = arrow(SIDES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                out = []
                for pq_id, run_name, _, *texts in zip(*map(values, whole.slice(at, 2048).columns)):
                    for side, text in zip(("question", "gold", "prediction"), texts):
                        out.append(prepare(pq_id, side, run_name, None if side == "question" else texts[0], text, rules))
                yield record_batch(zip(*out), schema)

    return latest.select("pq_id", *[f"r.{c}" for c in cols]).mapInArrow(run, SIDES)


def ending_counts(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context hash, ends, total) of the contexts some record closes with, and the words seen whole."""
    shared = sides.sparkSession.sparkContext.broadcast(wanted_filter(sides))

    ddl = "key bigint, word string, ends bigint, total bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ends, total, whole = place_endings(list(zip(*map(values, batch.columns))), shared.value)
            none = np.zeros(len(whole), np.int64)
            yield record_batch([np.concatenate([keys, none]), [None] * len(keys) + list(whole), np.concatenate([ends, none]), np.concatenate([total, none])], arrow(ddl))

    counted = sides.select("side", "words").mapInArrow(run, ddl)
    summed = stash(counted.groupBy("key", "word").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total")), "endings")
    return summed.where(F.col("word").isNull()).select("key", "ends", "total"), summed.where(F.col("word").isNotNull()).select("word")


def meets(a: list[str], b: list[str]) -> int:
    """How near-copy ``b`` stands where ``a`` ends: 1 goes on inside the sentence, -1 ends too, 0 no alignment.

    ``a`` and ``b``: symbols. ``b`` must contain 0.8 of the shingles of ``a``, whose last word may be a stump.
    """
    a = [t for t in a if is_word(t)]
    at = [i for i, t in enumerate(b) if is_word(t)]
    plain = [b[i] for i in at]
    one, two = shingles(a), shingles(plain)
    if not one or len(one & two) < ALIKE * len(one) and len((less := shingles(a[:-1])) & two) < ALIKE * max(len(less), 1):
        return 0
    for tail in (a[-4:], a[-5:-1]):
        for j in range(len(plain) - len(tail), -1, -1):
            if plain[j : j + len(tail)] != tail:
                continue
            end = j + len(tail)
            if a[-1] != tail[-1]:
                if end < len(plain) and plain[end].startswith(a[-1]) and plain[end] != a[-1]:
                    return 1
                continue
            return 1 if end < len(plain) and not is_stop(b[at[end - 1] + 1]) else -1
    return 0


def goes_on(a: list[str], b: list[str]) -> bool:
    """Whether text ``b`` (tokens) is a near-copy that goes on inside the sentence where ``a`` ends."""
    return meets(masked(a), masked(b)) > 0


def sentence_classes(sides: DataFrame) -> DataFrame:
    """class, words, open (a text ends with it openly), n (how often), whole (closed by a stop or a gold's end), for five words or more."""

    ddl = "class binary, words array<string>, open boolean, n bigint, whole bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for side, tokens, stop, marked in zip(*map(values, batch.columns)):
                parts = sentences_of(tokens)
                for i, (sentence, closed) in enumerate(parts):
                    if not enough_words(sentence):
                        continue
                    last = i == len(parts) - 1
                    row = found.setdefault(class_of(masked(sentence)), [sentence, False, 0, 0])
                    row[1] |= last and (not stop or marked)
                    row[2] += 1
                    row[3] += closed or last and side == "gold" and not marked
            if found:
                yield record_batch([list(found), *zip(*found.values())], arrow(ddl))

    counted = sides.where(F.col("side") != "question").select("side", "words", "stop", "marked").mapInArrow(run, ddl)
    return counted.groupBy("class").agg(F.any_value("words").alias("words"), F.max("open").alias("open"), F.sum("n").alias("n"), F.sum("whole").alias("whole"))


def copy_pairs(classes: DataFrame) -> DataFrame:
    """a, b: open classes and others that share a band of a prefix. ``classes``: class, open, bands."""
    asked = classes.where("open").select(F.col("class").alias("a"), F.explode(F.slice("bands", -BANDS, BANDS)).alias("band"))
    held = classes.select(F.col("class").alias("b"), F.explode("bands").alias("band"))
    return asked.join(held, "band").where(F.col("a") != F.col("b")).select("a", "b").distinct()


def copy_evidence(sides: DataFrame) -> DataFrame:
    """class, on, over of open sentences: in how many near-copies the sentence goes on, and in how many it ends.

    Only sentences that go on somewhere; what stands whole in the very words counts as ending.
    """
    ddl = "class binary, open boolean, n bigint, whole bigint, symbols array<string>, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = [masked(w) for w in values(batch.column("words"))]
            bands = band_keys([[t for t in x if is_word(t)] for x in symbols])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("class", "open", "n", "whole")], pa.array(symbols, _KINDS["array<string>"]), pa.array(bands, _KINDS["array<bigint>"])], schema=arrow(ddl))

    classes = stash(sentence_classes(sides).mapInArrow(run, ddl), "classes")
    pairs = copy_pairs(classes.select("class", "open", "bands"))
    pairs = pairs.join(classes.select(F.col("class").alias("a"), F.col("symbols").alias("mine")), "a").join(classes.select(F.col("class").alias("b"), "n", "whole", F.col("symbols").alias("other")), "b")
    met_ddl = "a binary, on bigint, over bigint"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, whole, mine, other = map(values, batch.columns)
            met = [meets(x, y) for x, y in zip(mine, other)]
            yield record_batch([a, [k if m > 0 else 0 for k, m in zip(n, met)], [k if m < 0 else 0 for k, m in zip(whole, met)]], arrow(met_ddl))

    met = pairs.select("a", "n", "whole", "mine", "other").mapInArrow(align, met_ddl)
    found = met.groupBy(F.col("a").alias("class")).agg(F.sum("on").alias("on"), F.sum("over").alias("over")).where("on > 0")
    return found.join(classes.select("class", "whole"), "class").select("class", "on", (F.col("over") + F.col("whole")).alias("over"))


def is_open() -> Column:
    return (F.col("side") != "question") & (~F.col("stop") | F.col("marked"))


def own_evidence() -> Column:
    """What a text itself adds to the copies that end: a gold counts as whole."""
    return F.when(F.col("side") == "gold", (~F.col("marked")).cast("int")).otherwise(0)


def continued_copies(sides: DataFrame) -> DataFrame:
    """(pq_id, side, on, over) of open-ended texts with a near-copy that goes on."""
    opened = sides.where(is_open()).select("pq_id", "side", own_evidence().alias("own"), "class")
    return opened.join(copy_evidence(sides), "class").select("pq_id", "side", "on", (F.col("over") - F.col("own")).alias("over"))


def closing_facts(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the corpus says of closings (c1, c2, best, word) and of last words (word_key, seen, begins).

    Texts that close alike (the same contexts, with or without a stop of their own) are
    one closing, so a context is looked up once for all of them.
    """
    counts, vocabulary = ending_counts(sides)
    closings = sides.where((F.col("side") != "question") & F.col("last").isNotNull()).select("keys", *closing_id(), own_end().alias("own"))
    asked = closings.groupBy("c1", "c2").agg(F.any_value("keys").alias("keys"), F.any_value("own").alias("own")).select("c1", "c2", "own", F.posexplode("keys").alias("n", "key"))
    scored = asked.join(counts, "key").select("c1", "c2", "n", (F.col("ends") - F.col("own")).alias("ends"), (F.col("total") - F.col("own")).alias("total"))
    best = scored.groupBy("c1", "c2").agg(
        F.max(F.when(F.col("total") >= SEEN, F.struct("n", "ends", "total"))).alias("best"),
        F.max(F.when(F.col("n") == 0, F.struct("ends", "total"))).alias("word"),
    )
    lasts = sides.where((F.col("side") != "question") & F.col("last").isNotNull()).select(F.lower("last").alias("word_key")).distinct()
    parts = F.expr("transform(sequence(1, length(word)), i -> struct(substring(word, 1, i) AS word_key, i = length(word) AS seen))")
    known = vocabulary.where(F.length("word") > 0).select(F.inline(parts)).groupBy("word_key").agg(F.max("seen").alias("seen"), F.max(~F.col("seen")).alias("begins"))
    return best, lasts.join(known, "word_key")


def own_end() -> Column:
    return ((F.col("side") == "gold") | F.col("stop")).cast("bigint")


def closing_id() -> list[Column]:
    return [F.xxhash64(F.lit(k), "keys", own_end()).alias(f"c{k}") for k in (1, 2)]


def closing_reason() -> Column:
    """Why a side counts as cut by its ending alone; NULL if it does not."""
    ratio = F.try_divide(F.col("best.ends"), F.col("best.total"))
    seen = F.coalesce(F.col("seen"), F.lit(False)) | F.col("last").rlike(r"^\d+$")
    begins = F.coalesce(F.col("begins"), F.lit(False))
    lower = F.col("last") == F.lower("last")
    rare = (F.col("word.total") >= 400) & (F.col("word.ends") <= F.col("word.total") * 0.0005)
    least = F.when(F.col("inner_stop"), LEAST_WITH_STOPS).otherwise(LEAST_WITHOUT)
    why = (
        F.when(F.col("broken"), F.lit("broken character"))
        .when(F.col("comma"), F.lit("ends at a comma"))
        .when(~seen & begins, F.lit("word cut inside"))
        .when(~seen, F.lit(None))
        .when(F.col("marked") | (F.col("unclosed") & ~F.col("stop")), F.when(F.coalesce(ratio < 0.5, F.lit(True)), F.lit("cut mark or open shell")))
        .when(F.col("stop"), F.when(F.coalesce(rare, F.lit(False)) | (ratio.isNull() & begins & lower), F.lit("stop behind a cut")))
        .when(ratio.isNull(), F.when(F.col("inner_stop"), F.lit("closing never seen")))
        .when(ratio < least, F.lit("closing words go on"))
    )
    return F.when(F.col("last").isNotNull(), why)


def find_cut(sides: DataFrame) -> DataFrame:
    """pq_id, side, run_name, found, cut, why for golds and predictions of prepared ``sides``."""
    best, words_known = closing_facts(sides)
    slim = ["pq_id", "side", "run_name", "found", "last", "broken", "comma", "marked", "unclosed", "stop", "inner_stop", "copied", "empty"]
    rows = sides.where(F.col("side") != "question").select(
        *slim, F.lower("last").alias("word_key"), *closing_id(), F.when(is_open(), F.col("class")).alias("class"), own_evidence().alias("own")
    )
    judged = rows.join(words_known, "word_key", "left").join(best, ["c1", "c2"], "left").join(copy_evidence(sides), "class", "left")
    over = F.col("over") - F.col("own")
    continued = over / (F.col("on") + over) < LEAST_COPIES
    why = F.when(continued & F.col("last").isNotNull(), F.lit("a copy goes on")).otherwise(closing_reason())
    why = F.when(~F.col("copied") & ~F.col("empty"), why)
    return judged.select("pq_id", "side", "run_name", "found", why.isNotNull().alias("cut"), why.alias("why"))

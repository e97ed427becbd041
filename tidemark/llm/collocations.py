r"""Phrase collocations from vertical positional inverted lists.

Texts are lower-cased (A-Z alone) and cut into pieces at `[.,;:!?\x0A-\x0D]` and pieces into words `[^\x20\x09]+`; a phrase never spans
pieces. Everything is counted per language. A frequent phrase is kept as the list of the places where it starts; the list of a longer one comes from
merging that list, moved by the phrase's length, with the postings of the word that follows, so a list's length is the exact frequency. A phrase
is extended only where it is frequent and where the phrase one place on (the same but for its first word, with the next one) is, too. Words that no frequent phrase covers are forgotten, so blocks shrink with each length.

Scale: texts are cut into blocks of about `BLOCK` words, at borders of pieces, and lists are kept by block: no list, and no group, is longer than
a block (or one piece). Per length of phrase, the blocks' distinct candidates are added up by phrase in one shuffle (partial sums first), and frequent ones
get an exact id in a written table. Where that table is small, by a sum of its bytes, it is sent to the workers and no block moves. Beyond that the ids go back by
a join on the phrase, a row for each block that has it and never one for an occurrence, and meet their blocks, packed, in a cogroup.
Scores are joins on exact word sequences, in decimals of 38 digits. The first of each language are found in salted parts, then among their winners.

Edge cases: a null text has no words; a null language is `und`, together with documents that say `und`; ids play no part, so null and repeated ones and repeated
rows count each; an empty table gives an empty result; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_shuffles, short_batches, small, written

#: Words in a block, about; bytes of a text that are split at a time, about.
BLOCK, PORTION = 1 << 20, 4 << 20
#: Parts in which the best of a language are looked for first.
PARTS = 64
#: A border between pieces, which no word can hold, and the byte table that turns all borders into it and lower-cases A-Z.
BORDER = b"."
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b",;:!?\n\x0b\x0c\r\t", string.ascii_lowercase.encode() + BORDER * 9 + b" ")

#: `word_at`: the number of the word at each place, from 1, and 0 at borders.
WORDS = "block long, lang array<string>, word array<string>, n array<long>, word_at binary"
#: `word_at` of frequent words alone, and `ids` by their numbers; `phrases`: ids of the frequent phrases, `n` and `places`: lengths of their lists, and the lists, one after
#: another. Phrases of one word have no lists, as `word_at` tells them.
STATE = "block long, word_at binary, ids array<long>, phrases array<long>, n array<long>, places binary"
CANDIDATES = "block long, number int, key long, n long"
#: Rows of candidates in an Arrow batch, at most; bytes of a broadcast table of frequent words or phrases, at most.
ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Bytes of an Arrow batch of blocks, about, and blocks in a row group of their files: more in one would all be unpacked at once, so that memory grew with a task's blocks.
BATCH_BYTES, GROUP_BLOCKS = 8 << 20, 1


class _Numbers(dict):
    """word -> number, the next one for a new word. All languages of a block share the count."""

    def __init__(self, names: list):
        super().__init__({BORDER: 0})
        self.names = names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self, word))
        self[word] = n = len(self.names)
        return n


def _portions(text: bytes) -> Iterator[bytes]:
    """`text` cut at borders into portions of about PORTION bytes."""
    first = 0
    while first < len(text):
        last = text.find(BORDER, first + PORTION) + 1 or len(text)
        yield text[first:last]
        first = last


def _lists(number_at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the lists of numbers 1 to `most`, all lists one after another, each in ascending order)."""
    order = np.argsort(number_at, kind="stable")
    lengths = np.bincount(number_at, minlength=most + 1)
    return lengths[1:], order[lengths[0] :]


def _packed(a: np.ndarray) -> bytes:
    kind = "<i4" if a.min(initial=0) < 0 or a.max(initial=0) > 65_535 else "<u2"
    raw = a.astype(kind).tobytes()
    return kind.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[11:], int.from_bytes(b[3:11], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, b[:3].decode()).astype(np.int64)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as the positional lists of their words."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("word_at", pa.binary())])
    made, names, tables, numbers, total = TaskContext.get().partitionId() << 32, [], {}, [], 0

    def block() -> pa.RecordBatch:
        lang_of = {id(t): lang for lang, t in tables.items()}
        at = np.concatenate(numbers)
        n = np.bincount(at, minlength=len(names) + 1)[1:]
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
        renumber = np.zeros(len(names) + 1, np.int64)
        renumber[order + 1] = np.arange(1, len(names) + 1)
        langs, words = [lang_of[id(names[i][0])] for i in order], [names[i][1].decode() for i in order]
        return pa.RecordBatch.from_pydict({"block": [made], "lang": [langs], "word": [words], "n": [n[order]], "word_at": [_packed(renumber[at])]}, schema)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for portion in _portions(text.as_buffer().to_pybytes().translate(_FOLD)):
                table = tables.setdefault(lang, _Numbers(names))
                found = np.fromiter(map(table.__getitem__, portion.replace(BORDER, b" . ").split()), np.int64)
                numbers += [found, np.zeros(1, np.int64)]  # documents and portions end with a border
                total += len(found) + 1
                if total >= BLOCK:
                    yield block()
                    made, names, tables, numbers, total = made + 1, [], {}, [], 0
    if names:
        yield block()


def _state(batch: pa.RecordBatch | pa.Table, row: int) -> dict:
    """One row, its lists of numbers as arrays: blocks are unpacked one at a time and never as objects, however many a batch holds."""
    out = {}
    for name in batch.schema.names:
        value, kind = batch.column(name)[row], batch.schema.field(name).type
        numbers = pa.types.is_list(kind) and pa.types.is_int64(kind.value_type)
        out[name] = value.values.to_numpy() if numbers and value.is_valid else value.as_py()
    return out


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (_state(batch, row) for batch in batches for row in range(batch.num_rows))


def _numbered(lengths: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The inverse of `_lists`: the number of the list at each place."""
    at = np.zeros(size, np.int64)
    at[places] = np.repeat(np.arange(1, len(lengths) + 1), lengths)
    return at


def _grown(state: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's lists of `length` words, each merged with the postings of the word that follows: (word_at, where candidates start, which each is, their phrases' and words' numbers)."""
    at = _unpacked(state["word_at"])
    phrase_at = at if length == 1 else _numbered(np.array(state["n"], np.int64), np.cumsum(_unpacked(state["places"])), len(at))
    # The phrase at a place, the word behind it, and the phrase one place on, which ends with that word.
    starts = np.flatnonzero(phrase_at[: max(len(at) - length, 0)])
    starts = starts[(at[starts + length] > 0) & (phrase_at[starts + 1] > 0)]
    known, which = np.unique(phrase_at[starts] * (len(state["ids"]) + 1) + at[starts + length], return_inverse=True)
    return at, starts, which, *np.divmod(known, len(state["ids"]) + 1)


def _keys(state: dict, length: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word_at, where candidates start, which each is, their keys: the phrase's id times `base`, plus the next word's)."""
    at, starts, which, prev, last = _grown(state, length)
    ids = np.array(state["ids"], np.int64)
    phrases = ids if length == 1 else np.array(state["phrases"], np.int64)
    return at, starts, which, phrases[prev - 1] * base + ids[last - 1]


def _candidates(length: int, base: int):
    """The phrases of `length` + 1 words that may be frequent, a row for each in each block, with the length of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in _states(batches):
            _, _, which, key = _keys(state, length, base)
            n = np.bincount(which, minlength=len(key))
            for i in range(0, len(key), ROWS):
                k = len(key[i : i + ROWS])
                yield pa.RecordBatch.from_pydict({"block": np.full(k, state["block"]), "number": np.arange(i, i + k, dtype=np.int32), "key": key[i : i + k], "n": n[i : i + k]})

    return run


def _state_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("block", pa.int64()), ("word_at", pa.binary()), ("ids", longs), ("phrases", longs), ("n", longs), ("places", pa.binary())])


def _renumbered(number: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(new number of each of `n` candidates, 0 where it is not frequent; ids by new number), given the numbers of the frequent ones."""
    order = np.argsort(number)
    renumber = np.zeros(n, np.int64)
    renumber[number[order]] = np.arange(1, len(order) + 1)
    return renumber, ids[order]


def _with_words(block: dict, number: np.ndarray, ids: np.ndarray) -> list[dict]:
    """A block's state with its frequent words alone; nothing if it has none."""
    renumber, ids = _renumbered(number, ids, len(block["n"]))
    at = np.r_[0, renumber][_unpacked(block["word_at"])]
    return [{"block": block["block"], "word_at": _packed(at), "ids": ids, "phrases": None, "n": None, "places": None}] if len(ids) else []


def _with_phrases(state: dict, length: int, grown: tuple, number: np.ndarray, ids: np.ndarray) -> list[dict]:
    """A block's state with the lists of `length` + 1 words that turned out frequent, and with the words that those cover: no longer phrase has others."""
    at, starts, which, key = grown
    renumber, phrases = _renumbered(number, ids, len(key))
    if not len(phrases):
        return []
    number_at = np.zeros(len(at), np.int64)
    number_at[starts] = renumber[which]
    n, places = _lists(number_at, len(phrases))
    ends = np.zeros(len(at) + 1, np.int64)
    ends[places] += 1
    ends[places + length + 1] -= 1
    at[np.cumsum(ends[:-1]) == 0] = 0
    return [{"block": state["block"], "word_at": _packed(at), "ids": state["ids"], "phrases": phrases, "n": n, "places": _packed(np.diff(places, prepend=0))}]


def _told(length: int, base: int):
    """A block's next state, given the numbers of its frequent candidates and their ids: for a cogroup. Length 0 keeps words."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        if len(block) and len(answers):
            state, found = _state(block, 0), (answers.column("number").to_numpy(), answers.column("id").to_numpy())
            out = _with_phrases(state, length, _keys(state, length, base), *found) if length else _with_words(state, *found)
        return pa.Table.from_pylist(out, _state_schema())

    return run


def _known(length: int, base: int, sent):
    """The same where all frequent words or phrases have been sent to the workers: no block moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in _states(batches):
            if length:
                grown, (keys, ids) = _keys(state, length, base), sent.value
                at = np.minimum(np.searchsorted(keys, grown[3]), max(len(keys) - 1, 0))
                number = np.flatnonzero(keys[at] == grown[3]) if len(keys) else np.zeros(0, np.int64)
                out = _with_phrases(state, length, grown, number, ids[at[number]] if len(keys) else number)
            else:
                hits = [(i, sent.value[pair]) for i, pair in enumerate(zip(state["lang"], state["word"], strict=True)) if pair in sent.value]
                out = _with_words(state, *np.array(hits, np.int64).reshape(-1, 2).T)
            for row in out:
                yield pa.RecordBatch.from_pylist([row], _state_schema())

    return run


def _sent(found: DataFrame, length: int):
    """The table (keys, id) for the workers, if its bytes, summed first, are few; else None."""
    texts = [F.octet_length(c) * 4 for c in ("lang", "word")] if length == 0 else []
    size = found.agg(F.sum(sum(texts, F.lit(16 if length else 200)))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    rows = found.toArrow()
    if length == 0:
        value = dict(zip(zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), strict=True), rows["id"].to_pylist(), strict=True))
    else:
        order = np.argsort(rows["key"].to_numpy())
        value = rows["key"].to_numpy()[order], rows["id"].to_numpy()[order]
    return found.sparkSession.sparkContext.broadcast(value)


def _dense(df: DataFrame) -> DataFrame:
    """`df`, written, with ids from 0 without gaps: a place within its partition after the rows of the partitions before."""
    rows = written(df.withColumn("id", F.monotonically_increasing_id()), "frequent")
    part = F.shiftright("id", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each partition
    before = counts.select("part", (F.sum("rows").over(Window.partitionBy().orderBy("part")) - F.col("rows")).alias("before"))
    out = rows.withColumn("part", part).join(small(before), "part").withColumn("id", F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before")
    found = written(out, "frequent")
    discard(rows)
    return found


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, words: array<string>, f) of all phrases of 1 to `longest` words that occur `least` times or more, (lang, n: all words) of each language)."""
    spark = docs.sparkSession
    short_batches(spark)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    texts = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    blocks = written(texts.mapInArrow(_post, WORDS), "postings", GROUP_BLOCKS)
    candidates = blocks.select("block", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("number", "c")).select("block", "number", "c.*")
    sizes = written(candidates.groupBy("lang").agg(F.sum("n").alias("n")), "lang-sizes")
    phrases, known, words, keys, base = None, None, None, ["lang", "word"], 1
    for length in range(1, longest + 1):
        found = _dense(candidates.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        if length == 1:
            words, base = found, found.count() + 1
            known = written(found.select("id", "lang", F.array("word").alias("words"), "f"), "phrases")
        else:
            before = known.select(F.col("id").alias("prev"), "lang", "words")
            ends = found.withColumn("prev", F.expr(f"key div {base}L")).withColumn("next", F.col("key") % base)
            known = ends.join(before, "prev").join(words.select(F.col("id").alias("next"), "word"), "next")
            known = written(known.select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f"), "phrases")
        phrases = known if phrases is None else phrases.unionByName(known)
        if length == longest:
            break
        if found.count() * base >= 1 << 63:
            raise ValueError("there are too many frequent phrases for keys of 64 bits")
        told = found.select(*keys, "id")
        if (sent := _sent(told, length - 1)) is not None:
            grown = blocks.mapInArrow(_known(length - 1, base, sent), STATE)
        else:
            answers = candidates.join(told, keys).select(F.col("block").alias("of"), "number", "id")
            grown = blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_told(length - 1, base), STATE)
        blocks, old = written(grown, "postings", GROUP_BLOCKS), blocks
        discard(old)
        keys, candidates = ["key"], blocks.mapInArrow(_candidates(length, base), CANDIDATES)
        del grown, told
        free_shuffles(spark)
    discard(blocks)
    return phrases.select("lang", "words", "f"), sizes


def _wide(c: str):
    return F.col(c).cast("decimal(19,0)")


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) of the phrases of two words or more: their cut of the lowest score, of equal ones the first."""
    counts = lambda words, n: phrases.select("lang", F.col("words").alias(words), F.col("f").alias(n))
    cuts = phrases.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("words", F.lit(1), F.col("k"))).withColumn("tail", F.expr("slice(words, k + 1, size(words) - k)"))
    # Parts of a frequent phrase are frequent, so both are among the phrases.
    cuts = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"]).join(small(sizes), "lang")
    up, down = (F.lit(1000).cast("decimal(4,0)") * (_wide("a") * _wide("n")).cast("decimal(34,0)")).cast("decimal(38,0)"), (_wide("l") * _wide("r")).cast("decimal(38,0)")
    cuts = cuts.withColumn("up", up).withColumn("down", down).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "words", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def within_longer(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, words) of the phrases of two words or more that lie inside a longer one with `percent` in a hundred of their frequency or more."""
    size = F.size("words")
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = phrases.where(size > 2).select("lang", F.explode(inner).alias("words"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    return phrases.join(longer, ["lang", "words"]).where(F.lit(100) * F.col("longer") >= F.col("f") * percent).select("lang", "words")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` collocations of each language of `docs` (lang, text), by score, then frequency, then phrase."""
    phrases, sizes = frequent_phrases(docs, longest, least)
    kept = scored(phrases, sizes).join(within_longer(phrases, percent), ["lang", "words"], "left_anti").withColumn("phrase", F.array_join("words", " "))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    top = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

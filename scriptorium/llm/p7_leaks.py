"""Problem 7: passages of evaluation items inside the corpus.

Both sides are word sequences in one normal form (compatibility forms, no case, no markup or punctuation). An item's own words
are those outside answer options and outside sentences that several items share. Windows have the size of the item: a
``parts``-th of its own words. Every window of either side is embedded by the CGK random walk: it is read with a pointer that
moves on or stays by a random bit per (step, word), so windows at a small edit distance give strings at a small Hamming
distance. A repetition samples positions of the embedding, and windows that agree on them meet; there are as many repetitions as
it takes to let a window with the allowed edits meet with probability ``target`` (measured on random windows, see
``repetitions``). A passage holds several windows, so pairs are missed far more rarely than windows.

Each meeting is verified: the banded edit distance of the two windows, word by word, must be within the allowed edits, and they
must share a run of words that this item alone has. For documents and items with verified windows the item's words that the document carries in order are counted exactly (``words_carried``), and
they must reach ``share`` of the item's own words. Runs of words that several items have are no evidence by themselves.

Scale: shared sentences, windows and runs are counted over all items in Spark, and items with the same words form one class, so
results don't depend on how items are grouped. The corpus is read once, whatever the number of items: documents keep only
windows whose keys stand in a Bloom filter of the items' keys (at most ``MAX_BITS`` bits; a fuller filter costs time, not
results), then keys join exactly. Only documents with such a window are written, shuffled and verified.

Defined cases: repeated item ids count once (the longest text); null texts and items with fewer than ``RUN`` own words match
nothing; empty tables give no rows; every (document, item) pair comes out once, also if a document stands in several rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed, spread

#: Production parameters.
PARTS, MIN_WIDTH, MAX_WIDTH, EDITED, TARGET = 12, 5, 32, 6, 0.9
SHARE, RUN, GAP = 1 / 3, 3, 6
MAX_BITS, BITS_PER_KEY, PROBES = 1 << 28, 64, 4

MARKS = re.compile("[­​-‏⁠-⁤﻿]")
TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*>|&[a-z]{2,6};|&#\d{1,5};")
WORD = re.compile(r"[^\W_]+")
OPTION = re.compile(r"^\s*(?:[-*]\s*)?\(?([A-Ha-h1-8])[).:]\s+\S")
SENTENCE_END = re.compile(r"(?<=[.!?;:。！？])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    """Normal words of a text."""
    if not text:
        return []
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "&" in text:
        text = TAGS.sub(" ", text)
    return WORD.findall(text.lower() if text.isascii() else text.casefold())


def sentences_of(text: str | None) -> list[list[str]]:
    """Words of each sentence of an item, without its answer options: labelled lines one after the other, however long."""
    lines = [line for line in (text or "").split("\n") if line.strip()]
    labels = [ord(m[1].lower()) if (m := OPTION.match(line)) else None for line in lines]
    near = lambda i, j: 0 <= j < len(lines) and labels[j] is not None and labels[j] - labels[i] == j - i
    kept = [line for i, line in enumerate(lines) if labels[i] is None or not (near(i, i - 1) or near(i, i + 1))]
    return [words for line in kept for s in SENTENCE_END.split(line) if (words := words_of(s))]


def width_of(n: int, parts: int = PARTS) -> int:
    """Words of a window of an item with ``n`` own words; few widths are used, since documents are read once for each."""
    if n < MIN_WIDTH:
        return n
    wanted, width = min(MAX_WIDTH, n // parts), MIN_WIDTH
    while (longer := max(width + 1, round(width * 1.25))) <= wanted:
        width = longer
    return width


def edits_of(width: int) -> int:
    """Edits that a window may have."""
    return max(1, width // EDITED)


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    out = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def word_code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1


class Walk:
    """One repetition for windows of one width: a CGK walk of two steps per word, and a sample of as many positions as words."""

    def __init__(self, width: int, repeat: int):
        self.width, self.steps = width, 2 * width
        self.seed = 1000 * width + repeat
        self.picked = np.zeros(self.steps, bool)
        self.picked[np.random.default_rng(self.seed).permutation(self.steps)[:width]] = True

    def keys(self, windows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """64-bit key per window (rows of indexes into the word codes ``values``): the sampled positions of its embedding, hashed."""
        n = len(windows)
        padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1).ravel()
        rows = np.arange(n) * (self.width + 1)
        pointer, key = np.zeros(n, np.int64), np.full(n, self.seed, np.uint64)
        for step in range(self.steps):
            at = padded[rows + pointer]
            if self.picked[step]:
                key = (key ^ values[at]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            moves = ((mix(values, self.seed * 64 + step) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
            pointer = np.minimum(pointer + moves[at], self.width)
        return key


@cache
def repetitions(width: int, target: float = TARGET, trials: int = 600, walks: int = 12) -> int:
    """Repetitions that let a window with the allowed edits meet its original with probability ``target``, measured on random windows."""
    rng = np.random.default_rng(width)
    plain = rng.integers(1, 4000, (trials, width))
    edited = np.zeros_like(plain)
    for row, words in enumerate(plain.tolist()):
        words += rng.integers(1, 4000, width).tolist()  # what follows in the text
        for _ in range(edits_of(width)):
            kind, at = int(rng.integers(3)), int(rng.integers(width))
            words[at : at + 1] = ([0], [], [0, words[at]])[kind]
        edited[row] = words[:width]
    values = np.concatenate([[0], rng.integers(1, 1 << 32, 4000)]).astype(np.uint64)
    met = np.mean([(walk.keys(plain, values) == walk.keys(edited, values)).mean() for walk in (Walk(width, r) for r in range(walks))])
    return max(1, int(np.ceil(np.log(1 - target) / np.log(1 - min(met, 1 - 1e-9)))))


def written(codes: np.ndarray) -> str:
    """Word codes as a text of one character per word, so that edit distances of texts are those of windows."""
    return "".join(map(chr, np.where(codes == 0, 0xFF, 0x100 + codes % 54_000).tolist()))


def common_in_order(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(here, row[j])
            left = here
    return row[-1]


def most_carried(ordered: list[tuple[int, int, int, bool]], gap: int) -> int:
    """No chain of the runs (sorted by place in the item) carries more: the item's words in runs and in gaps that may be joined."""
    total = end = 0
    for i, _, n, _ in ordered:
        begin = end if total and i - end <= gap else i
        total += max(0, i + n - begin)
        end = max(end, i + n)
    return total


def words_carried(item: list[str], own: list[bool], document: list[str], spots: list[int], run: int = RUN, gap: int = GAP, least: float = 0) -> int:
    """Words of the item that ``document`` carries in the item's order; 0 where it can't reach ``least``.

    ``own[i]`` tells whether no other item has the run that begins at word i. Around the spots, runs of at least ``run`` equal
    words are found; neighbouring runs with at most ``gap`` words between them on either side form a piece, together with the equal
    words in those gaps. A piece counts only if one of its runs is the item's own. The best chain of pieces in the item's order
    gives the result.
    """
    near = len(item) * (run + gap)  # a piece has a run and a gap at most for each word of the item
    spans: list[list[int]] = []
    for spot in sorted(spots):
        low, high = max(0, spot - near), min(len(document), spot + near)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    grams = defaultdict(list)
    for i in range(len(item) - run + 1):
        grams[tuple(item[i : i + run])].append(i)
    first = {gram[0] for gram in grams}
    runs: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
    for low, high in spans:
        open_runs: dict[int, tuple[int, int, bool]] = {}
        for d in range(low, high - run + 1):
            if document[d] not in first:
                continue
            for i in grams.get(tuple(document[d : d + run]), ()):
                begin, length, had = open_runs.get(d - i, (-1, 0, False))
                begin, length, had = (begin, length + 1, had or own[i]) if begin + length - run + 1 == d else (d, run, own[i])
                open_runs[d - i] = (begin, length, had)
                runs[d - i, begin] = (begin - (d - i), begin, length, had)
    ordered = sorted(runs.values())
    if not any(r[3] for r in ordered) or most_carried(ordered, gap) < least:
        return 0
    # Chains: a run may follow in the same piece (near) or start a further piece (anywhere later in both).
    piece = [(0, False)] * len(ordered)
    best = [0] * len(ordered)
    for k, (i, d, n, mine) in enumerate(ordered):
        options = [(n, mine, 0)]
        for j in range(k):
            pi, pd, pn, _ = ordered[j]
            cut = max(0, pi + pn - i, pd + pn - d)  # overlapping ends: no word counts twice
            if cut >= n or pi >= i or pd >= d:
                continue
            gap_i, gap_d = i - pi - pn, d - pd - pn
            if gap_i <= gap and gap_d <= gap:
                extra = common_in_order(item[pi + pn : i], document[pd + pn : d]) if gap_i > 0 and gap_d > 0 else 0
                options.append((piece[j][0] + n - cut + extra, piece[j][1] or mine, best[j] - (piece[j][0] if piece[j][1] else 0)))
            options.append((n - cut, mine, best[j]))
        count, held, before = max(options, key=lambda o: (o[2] + o[0] * o[1], o[0], o[1]))
        piece[k] = (count, held)
        best[k] = before + (count if held else 0)
    return max(best)


def item_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items as classes of equal words (``class``, ``words`` of its own, ``own`` flags of its runs, ``width``) and the ``item_id`` of each class.

    Sentences and runs are counted over all classes, so the result is the same however items are stored.
    """
    clean = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max_by(F.col("text").cast("string"), F.struct(F.length("text"), "text")).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentences = [[" ".join(s) for s in sentences_of(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sentences, pa.list_(pa.string()))], names=["item_id", "sentences"])

    read_items = clean.mapInArrow(read, "item_id long, sentences array<string>").withColumn("class", F.xxhash64(F.array_join("sentences", "\n")))
    read_items = checkpointed(read_items)
    classes = read_items.groupBy("class").agg(F.first("sentences").alias("sentences"))
    placed = classes.select("class", F.posexplode("sentences").alias("at", "sentence"))
    single = placed.groupBy("sentence").agg(F.count_distinct("class").alias("n")).where("n = 1").select("sentence")
    kept = placed.join(single, "sentence").groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda s: s["sentence"]), " ").alias("text"))
    words = kept.select("class", F.split("text", " ").alias("words")).where(F.size("words") >= RUN)
    run = lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, F.lit(RUN)), " "))
    runs = words.select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - RUN), run)).alias("at", "run"))
    alone = runs.groupBy("run").agg(F.count_distinct("class").alias("n")).where("n = 1").select("run")
    flags = runs.join(alone.withColumn("alone", F.lit(True)), "run", "left").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("alone", F.lit(False)).alias("alone")))), lambda r: r["alone"]).alias("own"))
    return checkpointed(words.join(flags, "class")), read_items.select("class", "item_id")


def item_keys(classes: DataFrame, repeats: dict[int, int]) -> DataFrame:
    """``key``, ``class``, ``window`` and ``runs``: the windows of every class that hold a run which no other class has, one character per
    word, under their key in each repetition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("window", pa.string()), ("runs", pa.list_(pa.string()))])
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for name, words, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                width = width_of(len(words))
                values = np.array([0, *map(word_code, words)], np.uint64)
                text = written(values[1:])
                runs = [[text[i : i + RUN] for i in range(at, at + width - RUN + 1) if own[i]] for at in range(len(words) - width + 1)]
                kept = [at for at, r in enumerate(runs) if r]
                windows = np.array(kept, np.int64).reshape(-1, 1) + 1 + np.arange(width)
                for repeat in range(repeats[width]):
                    out["key"] += Walk(width, repeat).keys(windows, values).view(np.int64).tolist()
                    out["class"] += [name] * len(kept)
                    out["window"] += [text[at : at + width] for at in kept]
                    out["runs"] += [runs[at] for at in kept]
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return classes.select("class", "words", "own").mapInArrow(run, "key long, class long, window string, runs array<string>")


def verified_spots(spots: DataFrame, keys: DataFrame) -> DataFrame:
    """``row``, ``class`` and ``spot`` of the met windows that stand within the allowed edits and share a run which only that class has.

    The document's window may be shorter or longer than the item's, by the allowed edits.
    """
    width = F.length("window")
    edits = F.greatest(F.lit(1), F.floor(width / EDITED).cast("int"))
    near = lambda d: F.levenshtein(F.substring("met", F.lit(1), width + d), "window", MAX_WIDTH // EDITED)
    distances = [F.when(F.lit(abs(d)) <= edits, near(d)) for d in range(-(MAX_WIDTH // EDITED), MAX_WIDTH // EDITED + 1)]
    close = F.exists(F.array(*distances), lambda x: (x >= 0) & (x <= edits))
    own = F.exists("runs", lambda r: F.col("met").contains(r))
    return spots.join(keys, "key").where(own).where(close).select("row", "class", "spot")


def bit_positions(values: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    return [(mix(values, 77 + p) & np.uint64(bits - 1)).astype(np.int64) for p in range(probes)]


def bloom_filter(values: DataFrame, n: int, probes: int = PROBES, bits_per_key: int = BITS_PER_KEY) -> tuple[int, np.ndarray]:
    """Number of bits and bitmap of a column of at most ``n`` long values, built in Spark; at most ``MAX_BITS`` bits (32 MB) reach the driver."""
    bits = int(min(MAX_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(max(1, n) * bits_per_key))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(bit_positions(batch.column(0).to_numpy().view(np.uint64), bits, probes))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["bit"])

    at = values.mapInArrow(run, "bit long")
    pages = at.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bitmap")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for page in pages:
        out[page["page"] * 4096 : (page["page"] + 1) * 4096] = np.frombuffer(page["bitmap"], np.uint8)
    return bits, out


def in_filter(values: np.ndarray, bloom: tuple[int, np.ndarray], probes: int = PROBES) -> np.ndarray:
    bits, bitmap = bloom
    out = np.ones(len(values), bool)
    for at in bit_positions(values, bits, probes):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


class Reader:
    """Words of documents as indexes into word codes: 0 for words that no item has. Its memory is bounded; emptying it changes speed only."""

    def __init__(self, known: tuple[int, np.ndarray], most: int = 400_000):
        self.known, self.most = known, most
        self.index: dict[str, int] = {}
        self.codes: list[int] = [0]

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat indexes of all words, and the codes they point to."""
        if len(self.index) > self.most:
            self.index, self.codes = {}, [0]
        fresh = list({w for words in texts for w in words if w not in self.index})
        codes = np.array([word_code(w) for w in fresh], np.uint64)
        for word, code, hit in zip(fresh, codes.tolist(), in_filter(codes, self.known, 1).tolist() if fresh else ()):
            self.index[word] = len(self.codes) if hit else 0
            if hit:
                self.codes.append(code)
        get = self.index.__getitem__
        return np.fromiter((get(w) for words in texts for w in words), np.int32), np.array(self.codes, np.uint64)


def run_codes(columns: Iterator[np.ndarray]) -> np.ndarray:
    """64-bit code of runs of words given word by word."""
    out = np.uint64(0)
    for column in columns:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_hits(texts: list[list[str]], reader: Reader, bloom: tuple[int, np.ndarray], runs: tuple[int, np.ndarray], repeats: dict[int, int]) -> Iterator[tuple[int, int, int, str]]:
    """Text number, word position, key and words (one character for each) of the windows whose key may be an item's, in every repetition.

    Windows that the verification would refuse whatever they meet are left out before: those with too many words that no item has, and
    those without a run that one item alone has.
    """
    codes, values = reader(texts)
    lengths = np.array([len(words) for words in texts])
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    seen = np.concatenate([[0], np.cumsum(codes != 0)])
    letters = written(values[codes])
    n_runs = max(0, len(codes) - RUN + 1)
    own = np.zeros(len(codes) + 1, np.int64)
    if n_runs:
        own[1 : n_runs + 1] = in_filter(run_codes(values[codes[k : n_runs + k]] for k in range(RUN)), runs)
    own = np.cumsum(own)
    ends = begins + lengths
    used, codes = np.unique(codes, return_inverse=True)
    values = values[used] if len(used) else values
    if len(used) and used[0]:
        values, codes = np.concatenate([[0], values]).astype(np.uint64), codes + 1
    for width in repeats:
        last = len(codes) - width + 1
        if last < 1:
            continue
        near = (text[:last] == text[width - 1 :]) & (seen[width:] - seen[:last] >= width - edits_of(width))
        reach = np.minimum(np.arange(last) + width + edits_of(width) - RUN + 1, len(codes))
        starts = np.flatnonzero(near & (own[reach] > own[:last]))
        windows = codes[starts[:, None] + np.arange(width)]
        for repeat in range(repeats[width]):
            keys = Walk(width, repeat).keys(windows, values)
            hit = np.flatnonzero(in_filter(keys, bloom))
            for at, key in zip(starts[hit].tolist(), keys[hit].view(np.int64).tolist()):
                row = int(text[at])
                yield row, at - int(begins[row]), key, letters[at : min(at + width + edits_of(width), int(ends[row]))]


def leak_matches(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``key``, ``item_id``, ``carried`` words and ``share`` of the item's own words for every document that carries a passage."""
    spark = documents.sparkSession
    source = spread(documents.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text")))
    kind = source.schema["doc_key"].dataType.simpleString()
    classes, members = item_classes(items)
    sizes = classes.groupBy(F.size("words").alias("n")).count().collect()  # as many rows as items have lengths
    n_words = sum(r["n"] * r["count"] for r in sizes)
    repeats = {width: repetitions(width) for width in sorted({width_of(r["n"]) for r in sizes})}
    n_keys = sum(r["n"] * r["count"] * repeats[width_of(r["n"])] for r in sizes)
    keys = checkpointed(item_keys(classes, repeats))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_code(w) for w in batch.column(0).to_pylist()], pa.int64())], names=["code"])

    known = bloom_filter(classes.select(F.explode("words").alias("word")).mapInArrow(codes, "code long"), n_words, probes=1)

    def own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for words, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.array([word_code(w) for w in words], np.uint64)
                codes.append(run_codes(values[k : len(words) - RUN + 1 + k] for k in range(RUN))[np.array(own, bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes or [np.empty(0, np.uint64)]).view(np.int64))], names=["code"])

    runs = bloom_filter(classes.select("words", "own").mapInArrow(own_runs, "code long"), n_words)
    shared = spark.sparkContext.broadcast((known, bloom_filter(keys.select("key"), n_keys), runs))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bloom, runs = shared.value
        reader = Reader(known)
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                hits: dict[int, list[dict]] = defaultdict(list)
                texts = [words_of(value) for value in batch.column(1).to_pylist()]
                for row, spot, name, window in window_hits(texts, reader, bloom, runs, repeats):
                    hits[row].append({"key": name, "spot": spot, "met": window})
                rows = pa.array(sorted(hits), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([hits[r] for r in sorted(hits)], spot_type)], names=["doc_key", "doc_text", "hits"])

    spot_type = pa.list_(pa.struct([("key", pa.int64()), ("spot", pa.int64()), ("met", pa.string())]))
    met = checkpointed(source.mapInArrow(meet, f"doc_key {kind}, doc_text string, hits array<struct<key:long,spot:long,met:string>>").withColumn("row", F.monotonically_increasing_id()))
    spots = verified_spots(met.select("row", F.inline("hits")), keys)
    pairs = spots.groupBy("row", "class").agg(F.array_sort(F.collect_set("spot")).alias("spots"))
    wanted = pairs.join(classes, "class").groupBy("row").agg(F.collect_list(F.struct("class", "spots", "words", "own")).alias("pairs"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 100):
                batch = whole.slice(begin, 100)
                out: dict[str, list] = {"row": [], "class": [], "carried": [], "own": []}
                for row, value, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    document = words_of(value)
                    for pair in pairs:
                        item = pair["words"]
                        least = share * len(item)
                        n = words_carried(item, pair["own"], document, pair["spots"], least=least)
                        if n and n >= least:
                            out["row"].append(row)
                            out["class"].append(pair["class"])
                            out["carried"].append(n)
                            out["own"].append(len(item))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int64()), ("class", pa.int64()), ("carried", pa.int32()), ("own", pa.int32())]))

    verified = met.select("row", "doc_text").join(wanted, "row").select("row", "doc_text", "pairs").mapInArrow(verify, "row long, class long, carried int, own int")
    named = verified.join(met.select("row", "doc_key"), "row").join(members, "class")
    return named.groupBy(F.col("doc_key").alias(key), "item_id").agg(F.max("carried").alias("carried"), F.max(F.col("carried") / F.col("own")).alias("share"))


def found(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    return leak_matches(documents, items, **options).select("doc_id", "item_id")


def suite_report(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Leaked items and carrying documents per suite; suites without a leak stay with zeros."""
    leaked = leak_matches(documents, items, **options).select("doc_id", "item_id")
    per_item = items.select("item_id", "suite").distinct().join(leaked.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    return per_item.groupBy("suite").agg(F.count("*").alias("n_items"), F.count("n").alias("n_leaked_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))

r"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words in which no piece of the model crosses a border: runs of
spaces with the characters after them, and line breaks and other characters that
no longer piece holds on their own. Words are encoded, not texts:

1. All texts are counted into words. The most frequent ones (as many as
   ``DICTIONARY_WORDS``, a bound on memory) make a dictionary.
2. Lattice: every word of it explodes into its substrings of bounded length, an
   equi-join with the piece table keeps those that are pieces, edges are grouped
   by word, and a Spark higher-order ``aggregate`` folds them. For unigram models
   the fold is Viterbi over end positions. For BPE models (the tokenizers at hand
   are such) the best path of scores is not what the model means, so the fold
   replays its merges: at each step the mergeable edge of highest score, leftmost
   first.
3. Tasks look words up in the dictionary. Words outside it are encoded in place by
   the same rule, so the bound changes the time and never the result.

Only words travel: texts and tokens are not shuffled. Characters that are not
pieces become byte pieces.

Defined results: null and empty texts have no tokens, and decode to the empty
text. Decoding gives back the text, except that U+2581 becomes a space (the model
itself does not tell them apart). Ids are passed on, null or repeated; repeated
rows get equal tokens. An empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

import heapq
import os
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize, small_batches, take_over, utf8

#: Where the tokenizer files are; a parameter of the environment, never copied.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SPACE = "\u2581"
#: Bounds: words in the dictionary, characters of a word in it, words of a generation that a worker remembers.
DICTIONARY_WORDS = 400_000
DICTIONARY_CHARS = 32
CACHE_WORDS = 150_000
#: Characters from which the words of a text are found one by one.
LONG_TEXT = 1 << 20
NEVER = float("inf")


@dataclass
class Pieces:
    """The piece table of a model."""

    kind: str
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    special: set[int]
    ids: dict[str, int] = field(default_factory=dict)
    costs: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.costs = {p: -self.scores[i] for p, i in self.ids.items()}

    @property
    def alone(self) -> str:
        """Characters inside texts that no longer piece holds: each is a word of its own."""
        held = {c for p in self.ids if len(p) > 1 for c in p}
        return "".join(c for c in "\n\r\t" if c not in held)


def load(path: str = f"{TOKENIZERS}/{MODEL}") -> Pieces:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    byte_ids = [0] * 256
    special = set()
    for i, p in enumerate(pieces):
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            special.add(i)
    crossing = [p for i, p in enumerate(pieces) if i not in special and SPACE in p.lstrip(SPACE)]
    if crossing:
        raise ValueError(f"pieces cross words: {crossing[:5]}")
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(m.serialized_model_proto())
    norm = spec.normalizer_spec
    if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only models that leave texts as they are, after a space, are handled")
    kind = {1: "unigram", 2: "bpe"}[spec.trainer_spec.model_type]
    scores = [m.get_score(i) for i in range(n)]
    return Pieces(kind, pieces, scores, byte_ids, m.unk_id(), special)


def word_pattern(p: Pieces) -> str:
    """Words of a text whose spaces are U+2581."""
    alone = p.alone
    return rf"[{alone}]|{SPACE}*+[^{SPACE}{alone}]++|{SPACE}++" if alone else rf"{SPACE}*+[^{SPACE}]++|{SPACE}++"


def prepare(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def spell(p: Pieces, part: str) -> list[int]:
    """Ids of a symbol of the lattice: its piece, or bytes of a character without one."""
    got = p.ids.get(part)
    return [got] if got is not None else [p.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]


def merge(p: Pieces, word: str) -> list[int]:
    """BPE in place: merge the neighbours whose union has the highest score, leftmost first."""
    return merge_long(p, word) if len(word) > 64 else merge_short(p, word)


def merge_short(p: Pieces, word: str) -> list[int]:
    parts, cost = list(word), p.costs.get
    costs = [cost(a + b, NEVER) for a, b in zip(parts, word[1:], strict=False)]
    last = len(costs) - 1
    while last >= 0:
        least = min(costs)
        if least == NEVER:
            break
        i = costs.index(least)
        grown = parts[i] = parts[i] + parts.pop(i + 1)
        if i < last:
            costs[i + 1] = cost(grown + parts[i + 1], NEVER)
        del costs[i]
        if i:
            costs[i - 1] = cost(parts[i - 1] + grown, NEVER)
        last -= 1
    ids = list(map(p.ids.get, parts))
    return ids if None not in ids else [i for part in parts for i in spell(p, part)]


def merge_long(p: Pieces, word: str) -> list[int]:
    """The same with a heap, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # of the symbol that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and end[b] - a <= p.longest:
            got = p.costs.get(word[a : end[b]])
            if got is not None:
                heapq.heappush(heap, (got, a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, z = heapq.heappop(heap)
        b = end[a]
        if not alive[a] or b >= n or not alive[b] or end[b] != z:
            continue
        end[a], alive[b] = z, False
        if z < n:
            before[z] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out += spell(p, word[a : end[a]])
        a = end[a]
    return out


def viterbi(p: Pieces, word: str, miss: float = -1e6) -> list[int]:
    """Unigram in place: the path of highest total score; later, that is longer, last pieces win ties."""
    n = len(word)
    best, back = [0.0] + [-float("inf")] * n, [0] * (n + 1)
    for z in range(1, n + 1):
        for a in range(max(0, z - p.longest), z):
            got = p.ids.get(word[a:z])
            score = p.scores[got] if got is not None else (miss if z - a == 1 else None)
            if score is not None and best[a] + score > best[z]:
                best[z], back[z] = best[a] + score, a
    cuts, z = [], n
    while z:
        cuts.append((back[z], z))
        z = back[z]
    return [i for a, z in reversed(cuts) for i in spell(p, word[a:z])]


def encode_word(p: Pieces, word: str) -> list[int]:
    return merge(p, word) if p.kind == "bpe" else viterbi(p, word)


def words_of(docs: DataFrame, p: Pieces) -> DataFrame:
    """(word, n): every word of every text, counted."""
    text = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    found = F.explode(F.regexp_extract_all(text, F.lit(word_pattern(p)), F.lit(0))).alias("word")
    return docs.where(F.length("text") > 0).select(found).groupBy("word").agg(F.count("*").alias("n"))


def lattice(words: DataFrame, p: Pieces) -> DataFrame:
    """(word, edges): all pieces inside each distinct word, best first.

    An edge has its cost, start and end, and as bits of a number its two borders
    and the borders between them (words of up to 62 characters).
    """
    spark = words.sparkSession
    table = spark.createDataFrame([(k, float(p.scores[i])) for k, i in p.ids.items() if len(k) > 1 or p.kind != "bpe"], "piece string, score double")
    least = 2 if p.kind == "bpe" else 1
    n = F.length("word")
    starts = words.where(n >= least).select("word", F.explode(F.sequence(F.lit(0), n - least)).alias("s"))
    ends = starts.select("word", "s", F.explode(F.sequence(F.col("s") + least, F.least(F.length("word"), F.col("s") + p.longest))).alias("e"))
    parts = ends.select("word", "s", "e", F.expr("substring(word, s + 1, e - s)").alias("piece"))
    edges = parts.join(F.broadcast(table), "piece")  # as many rows as the model has pieces
    one = F.lit(1).cast("long")
    left, right = F.call_function("shiftleft", one, F.col("s")), F.call_function("shiftleft", one, F.col("e"))
    edge = F.struct((-F.col("score")).alias("c"), "s", "e", (left + right).alias("ends"), (right - left * 2).alias("inside"))
    return edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def fold_merges(word: Column, edges: Column) -> Column:
    """Borders of the symbols of a word (62 characters at most) after all merges.

    The state is a number with a bit for each border. An edge can be merged if both
    its ends are borders and exactly one border lies between them.
    """
    one = F.lit(1).cast("long")

    def step(b: Column, _: Column) -> Column:
        # edges are in order: the first has the best score and is leftmost among equals
        ready = F.get(F.filter(edges, lambda m: (b.bitwiseAND(m["ends"]) == m["ends"]) & (F.bit_count(b.bitwiseAND(m["inside"])) == 1)), F.lit(0))
        return F.coalesce(b - b.bitwiseAND(ready["inside"]), b)

    full = F.call_function("shiftleft", one, F.length(word) + 1) - 1
    bits = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(word) - 1, F.size(edges)))), full, step)
    # the number stands outside the lambda, so that it is worked out once
    marks = F.transform(F.split(F.reverse(F.bin(bits)), ""), lambda c, i: F.when(c == "1", i).otherwise(-1))
    return F.filter(marks, lambda i: i >= 0)


def fold_viterbi(word: Column, edges: Column, miss: float = -1e6) -> Column:
    """Borders of the path of highest total score: the state holds, for each end, its score and path."""
    state = "array<struct<v:double,path:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("v"), F.array(F.lit(0)).alias("path"))).cast(state)

    def step(b: Column, z: Column) -> Column:
        def through(a: Column, score: Column) -> Column:
            return F.struct((F.get(b, a)["v"] + score).alias("v"), F.concat(F.get(b, a)["path"], F.array(z)).alias("path"))

        by_piece = F.transform(F.filter(edges, lambda e: e["e"] == z), lambda e: F.struct(through(e["s"], -e["c"]).alias("r"), (-e["s"]).alias("longer")))
        single = F.filter(F.array(z), lambda x: ~F.exists(edges, lambda e: (e["e"] == x) & (e["s"] == x - 1)))
        by_miss = F.transform(single, lambda x: F.struct(through(x - 1, F.lit(miss)).alias("r"), (1 - x).alias("longer")))
        options = F.transform(F.concat(by_piece, by_miss), lambda o: F.struct(o["r"]["v"].alias("v"), (-o["longer"]).alias("first"), o["r"]["path"].alias("path")))
        best = F.array_min(F.transform(options, lambda o: F.struct((-o["v"]).alias("c"), o["first"].alias("first"), o["path"].alias("path"))))
        return F.concat(b, F.array(F.struct((-best["c"]).alias("v"), best["path"].alias("path"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step), -1)["path"]


def encode_words(words: DataFrame, p: Pieces) -> DataFrame:
    """(word, borders) of each distinct word, by the lattice and its fold."""
    fold = fold_merges if p.kind == "bpe" else fold_viterbi
    none = F.array().cast("array<struct<c:double,s:int,e:int,ends:bigint,inside:bigint>>")
    full = words.select("word").join(lattice(words, p), "word", "left").select("word", F.coalesce("edges", none).alias("edges"))
    return full.select("word", fold(F.col("word"), F.col("edges")).alias("borders"))


def dictionary(docs: DataFrame, p: Pieces, most: int = DICTIONARY_WORDS) -> Dictionary:
    """The ids of the most frequent words, ``most`` at most."""
    counted = materialize(words_of(docs, p), "words")
    short = counted.where(F.length("word") <= DICTIONARY_CHARS)
    # from how many occurrences on the words fit: a table with a row for each count
    by_count = short.groupBy(F.least("n", F.lit(1 << 14)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 62
    for r in by_count:
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    chosen = materialize(short.where(F.col("n") >= least).select("word"), "dictionary-words")
    encoded = encode_words(chosen, p)
    kind, words, ids, ends = code_of(p), [], array(code_of(p)), array("I")
    for batch in encoded.toArrow().to_batches(max_chunksize=20_000):
        for w, b in zip(batch.column("word").to_pylist(), batch.column("borders").to_pylist(), strict=True):
            for a, z in zip(b, b[1:], strict=False):
                ids.extend(spell(p, w[a:z]))
            words.append(w)
            ends.append(len(ids))
    discard(counted, chosen)
    return Dictionary.of(words, [ids[a:z].tobytes() for a, z in zip([0, *ends], ends, strict=False)])


@dataclass
class Dictionary:
    """Encoded words in five byte strings: some 25 bytes a word, sent as they are and looked up in place.

    Words are in order of their CRC-32. Of words that share one, only one is found
    here; the others are encoded in place, so results do not depend on it.
    """

    keys: bytes = b""
    words: bytes = b""
    word_ends: bytes = b""
    ids: bytes = b""
    id_ends: bytes = b""

    @classmethod
    def of(cls, words: list[str], ids: list[bytes]) -> Dictionary:
        raw = [w.encode() for w in words]
        keys = np.array([zlib.crc32(w) for w in raw], np.uint32)
        order = np.argsort(keys, kind="stable").tolist()
        raw, ids = [raw[i] for i in order], [ids[i] for i in order]
        ends = lambda parts: np.cumsum([len(x) for x in parts]).astype(np.uint32).tobytes()
        return cls(np.sort(keys).tobytes(), b"".join(raw), ends(raw), b"".join(ids), ends(ids))

    def finder(self):
        """Function of a word: the bytes of its ids, or None."""
        keys, word_ends, id_ends = (memoryview(x).cast("I") for x in (self.keys, self.word_ends, self.id_ends))
        words, ids, crc32 = self.words, self.ids, zlib.crc32
        # keys are spread evenly: where those with the same upper half begin leaves a few to look at
        begins = np.searchsorted(np.frombuffer(self.keys, np.uint32), np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(16)).tolist()

        def find(word: str) -> bytes | None:
            raw = word.encode()
            key = crc32(raw)
            end = begins[(key >> 16) + 1]
            i = bisect_left(keys, key, begins[key >> 16], end)
            if i == end or keys[i] != key or words[word_ends[i - 1] if i else 0 : word_ends[i]] != raw:
                return None
            return ids[id_ends[i - 1] if i else 0 : id_ends[i]]

        return find


class Table(dict):
    """Words to the bytes of their ids: looked up in the dictionary or encoded in place, and remembered.

    Two generations of ``CACHE_WORDS`` at most: a word that is met again moves on, others go.
    """

    def __init__(self, known: Dictionary, p: Pieces):
        super().__init__()
        self.p, self.kind, self.find, self.old = p, code_of(p), known.finder(), {}
        self.pattern = re.compile(word_pattern(p))
        self.alone = re.compile(f"[{p.alone}]" if p.alone else "(?!)")

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            inside = self.pattern.findall(word) if self.alone.search(word) else ()
            if len(inside) > 1:
                return b"".join(map(self.__getitem__, inside))
            ids = self.find(word)
        if ids is None:
            ids = array(self.kind, encode_word(self.p, word)).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> Iterator[str]:
        """The words of a text, or runs of words without a space; those of a long one are not held all at once."""
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.pattern.finditer(prepare(text)))
        if not text or text[0] == " " or "  " in text or SPACE in text:
            return iter(self.pattern.findall(prepare(text)))
        # all spaces are single ones before other characters: each begins a word
        return iter((SPACE + text.replace(" ", " " + SPACE)).split(" "))

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text or "")))


def code_of(p: Pieces) -> str:
    return "H" if len(p.pieces) <= 1 << 16 else "I"


def encoder(spark: SparkSession, p: Pieces, known: Dictionary):
    """Function of batches of texts: for each text the list of its ids."""
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((p, known))

    def encode(texts: list[str | None]) -> Iterator[np.ndarray]:
        tables = take_over("sentencepiece")
        if name not in tables:  # one table for a worker, whatever number of tasks it runs
            tables.clear()
            model, words = shared.value
            tables[name] = Table(words, model)
        table = tables[name]
        for t in texts:
            yield np.frombuffer(table.ids(t), table.kind)

    return encode


def spelled(p: Pieces) -> pa.Array:
    """The bytes of each piece; control pieces have none."""
    out = [b"" if i in p.special else x.encode("utf-8", "surrogatepass") for i, x in enumerate(p.pieces)]
    for b, i in enumerate(p.byte_ids):
        if i:
            out[i] = bytes([b])
    return pa.array(out, pa.large_binary())


def decoded(table: pa.Array, ids: np.ndarray | pa.Array, lengths: np.ndarray) -> Iterator[bytes]:
    """The texts in UTF-8 of lists of ids that stand one after the other, by the bytes of each piece."""
    data, at = utf8(table.take(pa.array(ids, pa.int32())))
    ends = at[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    for a, z in zip(ends, ends[1:], strict=False):
        raw = data[a:z].tobytes().replace(SPACE.encode(), b" ")
        yield raw[1:] if raw.startswith(b" ") else raw


def decode(p: Pieces, ids: list[int]) -> str:
    """The text of ids."""
    return next(decoded(spelled(p), ids, np.array([len(ids)]))).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, p: Pieces | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    p = p or load()
    encode = encoder(spark, p, dictionary(docs, p, most))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = list(encode(b.column("text").to_pylist()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, p: Pieces | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    spark = encoded.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(spelled(p or load()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            texts = [x.decode("utf-8", "replace") for x in decoded(shared.value, ids.flatten(), lengths)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def digest(docs: DataFrame, p: Pieces | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), round_trip (decoding the ids gives the text, U+2581 counting as a space)."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    p = p or load()
    encode = encoder(spark, p, dictionary(docs, p, most))
    shared = spark.sparkContext.broadcast(spelled(p))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = list(encode(texts))
            n = np.array([len(x) for x in ids], np.int64)
            crc = [zlib.crc32(x.astype("<i4").tobytes()) for x in ids]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            back = [x == (t or "").replace(SPACE, " ").encode() for x, t in zip(decoded(shared.value, flat, n), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))

"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over 16 bytes cuts every text into chunks of about 512 bytes; equal passages
   get equal cuts. Keys of chunks are counted over all documents.
2. Chunks that occur more than once are encoded once each, into a dictionary table. Which
   occurrences may be shared is asked of a bitmap made from the counts, with 128 bits for each shared chunk
   and at most 128 MB; its false hits only put a few single chunks into the dictionary too.
3. Documents are dealt into buckets together with the dictionary rows that the bucket needs.
   Chunks outside the dictionary are encoded in place. At each join the words that a cut may
   have split are encoded again, over a window that grows until it starts and ends at white
   space: there the tokenizer starts afresh, so the ids of both chunks agree with the whole
   text's from there on.

Cuts at white space are exact for tokenizers that drop it and never join over it, which
``WordEncoder`` checks of the file. Texts with special-token marks or with control
characters that libraries class differently are encoded whole by the library.

Defined results: a null text counts as empty and gives no ids; repeated rows give equal rows;
a null doc_id is kept; texts of any length are encoded whole; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_written, forget, parallel, table, worker_cache, written
from lumenframe.llm.kernels import U64, blocks, joined, prefix_hash, window_hash
from lumenframe.llm.moving import SCHEMA, blocks_by_bucket, buckets_for, by_bucket, dealt, emitted, gathered, id_bucket, text_bytes, unpacked
from lumenframe.llm.tokens import CACHE, LONGEST, UNSURE, byte_symbols, little_endian

ROLL, MEAN, MOST = 16, 512, 8192
#: Marks that end a word as a piece of their own; none of them starts a contraction.
MARKS = ",.;:!?|*#$%&"
#: Least and most bits of the bitmap of shared chunks, and bits for each.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 1 << 18, 1 << 30, 128


class _Words(dict):
    """word -> packed ids; words not met before are encoded.

    Letters of the Latin blocks lower-case one by one and are one piece, so such a word needs the
    merges only; a mark after a letter is a piece of its own, so a word with one is its two parts.
    """

    def __init__(self, enc: WordEncoder):
        super().__init__()
        self.enc = enc

    def __missing__(self, word: str) -> bytes:
        enc = self.enc
        if enc.plain and len(word) < 200:
            if word[-1] in MARKS and len(word) > 1 and word[-2].isalpha():
                return self[word[:-1]] + self[word[-1]]
            if word.isalpha() and max(word) < "\u0250":
                low = word.lower()
                if low.isalpha():
                    return self.keep(word, [t.id for t in enc.merges(low.encode().decode("latin-1").translate(enc.symbols))])
        return self.keep(word, enc.ids(word))

    def keep(self, word: str, ids: list[int]) -> bytes:
        packed = little_endian(ids, self.enc.dtype)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = packed
        return packed


class WordEncoder:
    """Encodes texts word by word with a tokenizer file that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.load(open(path, encoding="utf-8"))
        pre = model.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in str(first.get("pattern"))
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.merges, self.words, self.plain = self.library.model.tokenize, _Words(self), False
        norm = [x.get("type") for x in (model.get("normalizer") or {}).get("normalizers", ())]
        second = (pre.get("pretokenizers") or [{}])[-1]
        plain = norm == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+" in (first.get("pattern") or {}).get("Regex", "") and second.get("type") == "ByteLevel" and not second.get("use_regex") and not second.get("add_prefix_space")
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.pieces = self._decoder_table(model)
        probes = ("a", "The", "word,", "straße.", "Été", "ÀÇÑÖ|", "don't", "x1", "naïve***")
        want = [self.words[w] for w in probes]
        self.words.clear()
        self.plain = plain
        self.plain = plain and [self.words[w] for w in probes] == want
        self.words.clear()

    def _decoder_table(self, model: dict):
        """Bytes of all tokens, each with a space after it, one after the other, where each starts, and their lengths, if the file names no decoder, so that tokens are joined by spaces; else None."""
        if model.get("decoder"):
            return None
        size = self.library.get_vocab_size()
        tokens = [self.library.id_to_token(i) for i in range(size)]
        if None in tokens:
            return None
        own = [t.encode() + b" " for t in tokens]
        length = np.array([len(x) for x in own], dtype=np.int64)
        table = np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(length) - length, length
        probe = self.ids("Naïve 東京 don't <|endoftext|> x1, é") + [0, size - 1]
        return table if self.joined(probe, table).decode() == self.library.decode(probe, skip_special_tokens=False) else None

    @staticmethod
    def joined(ids, table) -> bytes:
        """The bytes of the tokens, with spaces between."""
        buf, start, length = table
        n = length[ids]
        end = np.cumsum(n)
        return buf[np.repeat(start[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)][:-1].tobytes()

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype=self.dtype).tobytes()

    def sure(self, text: str) -> bool:
        return self.by_word and not UNSURE.search(text)


def word_encoder(path: str) -> WordEncoder:
    cache = worker_cache()
    if ("word", path) not in cache:
        cache["word", path] = WordEncoder(path)
    return cache["word", path]


def cut(texts: list[bytes]) -> list[list[bytes]]:
    """The content-defined chunks of each text."""
    out: list[list[bytes]] = []
    for i, j in blocks(texts):
        buf, at = joined(texts[i:j])
        hit = np.flatnonzero((window_hash(prefix_hash(buf), ROLL) & U64(MEAN - 1)) == 0) + ROLL
        hit = hit[hit < len(buf)]
        hit = hit[(buf[hit] & 0xC0) != 0x80]
        bounds = np.searchsorted(hit, at)
        for k, t in enumerate(texts[i:j]):
            # A window that starts before the text would depend on its neighbour.
            own = [int(x) for x in hit[bounds[k] : bounds[k + 1]] - at[k] if ROLL <= x < len(t)]
            edges = [0]
            for e in [*own, len(t)]:
                while e - edges[-1] > MOST:
                    f = edges[-1] + MOST
                    while t[f] & 0xC0 == 0x80:
                        f -= 1
                    edges.append(f)
                if e > edges[-1]:
                    edges.append(e)
            out.append([t[a:b] for a, b in zip(edges, edges[1:], strict=False)])
    return out


def chunk_key(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def marked_slots(keys: list[bytes], bitmap: np.ndarray) -> np.ndarray:
    """Indices of the keys whose slot, low bits of the key, is marked."""
    slot = (np.frombuffer(b"".join(keys), dtype=np.uint64)[::2] & U64(8 * len(bitmap) - 1)).astype(np.int64)
    return np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def encode_chunk(chunk: str, enc: WordEncoder) -> tuple[bytes, int, int]:
    """Ids, and bytes of ids of the first and of the last word that a cut may have split."""
    parts = [enc.words[w] for w in chunk.split()]
    if not parts:
        return b"", 0, 0
    return b"".join(parts), 0 if chunk[0].isspace() else len(parts[0]), 0 if chunk[-1].isspace() else len(parts[-1])


def assemble(chunks: list[str], coded: list[tuple[bytes, int, int]], enc: WordEncoder) -> bytes:
    """Ids of the whole text from its chunks, with repaired joins."""
    out: list[bytes] = []
    open_word = ""  # the last word so far; the next chunk may continue it
    for c, (ids, head, tail) in zip(chunks, coded, strict=True):
        end = len(ids) - tail
        if c[0].isspace():
            if open_word:
                out.append(enc.words[open_word])
            out.append(ids[:end])
        else:
            first = c.split(None, 1)[0]
            open_word += first
            if len(first) == len(c):
                continue
            out.append(enc.words[open_word])
            out.append(ids[head:end])
        open_word = "" if c[-1].isspace() else c.rsplit(None, 1)[-1]
    if open_word:
        out.append(enc.words[open_word])
    return b"".join(out)


def _sure_chunks(part: pa.RecordBatch, enc: WordEncoder) -> list[list[bytes]]:
    texts = part.column("text").to_pylist()
    return cut([t.encode("utf-8", "surrogatepass") if t and enc.sure(t) else b"" for t in texts])


def shared_map(docs: DataFrame, tokenizer: str) -> np.ndarray:
    """Bitmap of the slots of chunks that occur more than once."""

    def count(batches):
        forget("word")
        enc = word_encoder(tokenizer)
        for b in gathered(batches):
            keys = [chunk_key(c) for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)) for cs in _sure_chunks(part, enc) for c in cs]
            if keys:
                k, n = np.unique(np.frombuffer(b"".join(keys), dtype=np.uint64)[::2].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

    found = docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    shared = written(found.select("key"), "bpe-shared")
    bits = min(max(LEAST_BITS, 1 << (CHUNK_BITS * shared.count()).bit_length()), MOST_BITS)
    slot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    # Slices of 4 KB, merged on the executors; all together are the bitmap, of bounded size.
    slices = shared.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for at, own in slices.collect():
        room = out[(at - 1) * 4096 : at * 4096]
        room[:] = np.frombuffer(own, dtype=np.uint8)[: len(room)]
    drop_written(shared)
    return out


def row_buckets(part: pa.RecordBatch, n: int) -> np.ndarray:
    """The bucket of each row by its doc_id; rows without one are dealt by their text and place."""
    import xxhash

    ids = part.column("doc_id").cast(pa.int64())
    out = ids.fill_null(0).to_numpy(zero_copy_only=False).copy()
    for r in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[r] = (xxhash.xxh64_intdigest(part.column("text")[r].as_py() or "") >> 1) ^ (r % 64)
    return id_bucket(out, n)


def packed_ids(ids: list[bytes], enc: WordEncoder) -> list[pa.Array]:
    """What encode() returns of each text unless told otherwise: the ids and the bytes of one."""
    return [pa.array(ids, pa.binary()), pa.array([int(enc.dtype[-1])] * len(ids), pa.int32())]


def encode(docs: DataFrame, tokenizer: str, finishing=packed_ids, fields: str = "ids binary, width int", bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, ids (packed little-endian), width (bytes of an id), n_tokens, n_chunks, n_reused of docs (doc_id, text).

    ``finishing`` may put other ``fields`` in place of the ids; it runs in the worker that encodes,
    since every further Python step of a stage would be one more process for each core.
    """
    spark = docs.sparkSession
    docs = parallel(docs.select("doc_id", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = buckets_for(text_bytes(docs), bucket_bytes, spark.sparkContext.defaultParallelism)
    bitmap = spark.sparkContext.broadcast(shared_map(docs, tokenizer))

    def occurrences(batches):
        """Blocks of kind 0: texts of shared chunks by key; of kind 1: keys that a bucket of documents needs."""
        enc = word_encoder(tokenizer)
        held = bitmap.value

        def rows():
            for b in gathered(batches):
                texts: dict[bytes, bytes] = {}
                needs: set[tuple[int, bytes]] = set()
                for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                    for bucket, cs in zip(row_buckets(part, n_buckets).tolist(), _sure_chunks(part, enc), strict=True):
                        keys = [chunk_key(c) for c in cs]
                        if keys:
                            for k in marked_slots(keys, held).tolist():
                                texts[keys[k]] = cs[k]
                                needs.add((bucket, keys[k]))
                if texts:
                    keys = list(texts)
                    own = (np.frombuffer(b"".join(keys), dtype=np.uint64)[1::2] % U64(n_buckets)).astype(np.int32)
                    yield from blocks_by_bucket(pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([texts[k] for k in keys], pa.binary())], names=["key", "chunk"]), own, 0)
                    pairs = list(needs)
                    yield from blocks_by_bucket(pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs], pa.binary())], names=["key"]), np.array([x for x, _ in pairs], dtype=np.int32), 1)

        yield from emitted(rows())

    occ = written(docs.mapInArrow(occurrences, SCHEMA), "bpe-occurrences", "none")

    def dictionary(batches):
        enc = word_encoder(tokenizer)
        for _, rows in by_bucket(batches):
            texts: dict[bytes, bytes] = {}
            for _, block in rows:
                t = unpacked(block)
                texts.update(zip(t.column("key").to_pylist(), t.column("chunk").to_pylist(), strict=True))
            coded = [encode_chunk(c.decode("utf-8", "surrogatepass"), enc) for c in texts.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(texts), pa.binary()), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.int32()), pa.array([c[2] for c in coded], pa.int32())], names=["key", "ids", "head", "tail"]
            )

    entries = written(dealt(occ.where("kind = 0"), max(parts, n_buckets)).mapInArrow(dictionary, "key binary, ids binary, head int, tail int"), "bpe-dictionary")

    def keys_of(batches):
        for b in batches:
            for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                k = unpacked(block).column("key").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(k), pa.int32()), k], names=["bucket", "key"])

    needs = occ.where("kind = 1").mapInArrow(keys_of, "bucket int, key binary").distinct()
    side = needs.join(entries, "key").select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("block"), "key", "ids", "head", "tail")

    def texts(batches):
        def rows():
            for b in gathered(batches):
                yield from blocks_by_bucket(b, row_buckets(b, n_buckets), 1)

        yield from emitted(rows())

    none = F.lit(None)
    main = docs.mapInArrow(texts, SCHEMA).select("bucket", "kind", "block", none.cast("binary").alias("key"), none.cast("binary").alias("ids"), none.cast("int").alias("head"), none.cast("int").alias("tail"))
    both = side.unionByName(main).repartition(max(parts, n_buckets), "bucket").sortWithinPartitions("bucket", "kind")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in fields.split(", ")]

    def finish(batches):
        enc = word_encoder(tokenizer)
        width = int(enc.dtype[-1])
        bucket, own = None, {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "block", "key", "ids", "head", "tail")), strict=True):
                if row[0] != bucket:
                    bucket, own = row[0], {}
                if row[1] == 0:
                    own[row[3]] = row[4:]
                    continue
                t = unpacked(row[2]).combine_chunks().to_batches()
                for part in (whole.slice(x, 500) for whole in t for x in range(0, whole.num_rows, 500)):
                    out, n_chunks, n_reused = [], [], []
                    for text, cs in zip(part.column("text").to_pylist(), _sure_chunks(part, enc), strict=True):
                        if not cs:
                            out.append(enc.packed(text) if text else b"")
                            n_chunks.append(0)
                            n_reused.append(0)
                            continue
                        strs = [c.decode("utf-8", "surrogatepass") for c in cs]
                        found = [own.get(chunk_key(c)) for c in cs]
                        out.append(assemble(strs, [f or encode_chunk(c, enc) for f, c in zip(found, strs, strict=True)], enc))
                        n_chunks.append(len(cs))
                        n_reused.append(sum(f is not None for f in found))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), *finishing(out, enc), pa.array([len(x) // width for x in out], pa.int64()), pa.array(n_chunks, pa.int32()), pa.array(n_reused, pa.int32())],
                        names=["doc_id", *names, "n_tokens", "n_chunks", "n_reused"],
                    )

    return both.mapInArrow(finish, f"doc_id {id_type}, {fields}, n_tokens long, n_chunks int, n_reused int")


def wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def decoded(ids: bytes, enc: WordEncoder) -> str:
    """The library's decode, special tokens kept."""
    own = np.frombuffer(ids, enc.dtype)
    if enc.pieces is not None:
        return enc.joined(own, enc.pieces).decode()
    return enc.library.decode(own.tolist(), skip_special_tokens=False)


def decode(encoded: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """The kept columns and decoded text of encoded ids."""
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep), "decoded string"])

    def run(batches):
        enc = word_encoder(tokenizer)
        for b in batches:
            for part in (b.slice(x, 500) for x in range(0, b.num_rows, 500)):
                texts = [decoded(x, enc) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(ids: list[bytes], enc: WordEncoder) -> list[pa.Array]:
    """SHA-256 of the ids as unsigned 32-bit integers, and of the text decoded from them."""
    width = int(enc.dtype[-1])
    sha = [hashlib.sha256(wide(x, width)).hexdigest() for x in ids]
    back = [hashlib.sha256(decoded(x, enc).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
    return [pa.array(sha, pa.string()), pa.array(back, pa.string())]


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests, "ids_sha256 string, decoded_sha256 string")
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused")

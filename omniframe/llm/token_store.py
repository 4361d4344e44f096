"""Operator 10: token-id shards with a minimal perfect hash index.

``write`` encodes texts and lays their ids out in ascending key order in binary
shards; ``read_back`` looks every document up through the index.

A shard is two files (all integers little-endian). ``.ids`` holds the raw ids,
uint16 or uint32, document after document. ``.idx`` holds::

    magic 8 bytes b"TOKSHRD2"
    header: uint32 id_bytes (2 or 4), uint64 n_docs, uint64 n_ids,
            uint64 n_keys, uint64 n_buckets, uint64 seed
    ends     uint64[n_docs]    end of each document, in ids, in key order
    displ    uint32[n_buckets] displacement of each bucket of the perfect hash
    slots    n_keys records (uint32 fingerprint, uint32 first document, uint32 documents)

A lookup hashes the key once, reads one displacement, one slot, its two ends and
the ids between them, so it takes constant time whatever the shard's size. A key
that is not in the shard is turned away by the stored 32-bit fingerprint. Several
documents with one key share a slot (their number is stored); a null key is a
key like any other and sorts first.

Shards are ranges of (key, hash of the text), about ``SHARD_BYTES`` of text each,
so their number follows the data, and a key that a third of the rows share is
spread over several. Ids stand in ascending key order over the whole set, and a
router of four numbers a shard finds the shards of a key. The payload is written and
read in bounded pieces; a task holds only the index of its shard. Each file is
written under a name of its attempt and then renamed, so a task that runs twice
leaves one whole file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import durable, words

MAGIC = b"TOKSHRD2"
HEAD = struct.Struct("<8sIQQQQQ")
SLOT = np.dtype([("mark", "<u4"), ("first", "<u4"), ("count", "<u4")])
LOAD = 4  # keys a bucket of the perfect hash
MANIFEST = "shard long, n_docs long, n_ids long, first_key long, last_key long"
#: Bytes of text in one shard.
SHARD_BYTES = 32 << 20
#: Smaller inputs are cut into as many shards as there are cores, of at least so many bytes.
LEAST_BYTES = 1 << 20
#: Ids read at a time.
READ_IDS = 1 << 20


#: What must stand in a tokenizer's file for its texts to be cut at ASCII blanks (fixed values of the format).
CUT_SAFE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, equal ones encoded once.

    A tokenizer of the ``CUT_SAFE`` kind may be given a text word by word (runs
    between ASCII blanks): no character composes with a blank (NFC), lower case
    is taken letter by letter, no match of the splitting pattern holds a blank,
    and no added token does. Inside a word of ASCII alone, NFC does nothing
    and a letter is always cut from a following ``.,;:!?``, so such a word's
    lower case is cut there too. Words with other characters, or with ``<|`` as
    in the added tokens, go to the library as they are, many at a time with an added token
    between them. Each distinct unit is encoded once and kept in a bounded memory. Texts of any other tokenizer are
    encoded whole.
    """

    KEEP = 400_000

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end_id = end_id
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.id_type = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
        kind = json.loads(self.tok.to_str())
        first = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0]
        added = kind.get("added_tokens", [])
        plain = all(a["content"].startswith("<|") and not re.search(r"\s", a["content"]) and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added)
        self.by_words = (kind.get("normalizer"), first) == CUT_SAFE and plain and not kind.get("truncation")
        #: An added token, which cuts a text before anything else is done to it, and its id.
        self.apart = next(((a["content"], a["id"]) for a in added if self.by_words), None)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 256):
            out += [np.array(e.ids, self.id_type).tobytes() for e in self.tok.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
        return out

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if u.isascii() and u.isalpha()]
        for k in range(0, len(plain), 256):
            part = plain[k : k + 256]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.id_type)
            # letters alone are one piece, and a piece ends with the one mark of its end
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, w = ids.tobytes(), self.id_type.itemsize
                at = [0, *(cut * w).tolist()]
                self.known.update(zip(part, (raw[a:b] for a, b in zip(at, at[1:]))))
            else:
                self.known.update(zip(part, self.whole(part)))
        rest = [u for u in units if not (u.isascii() and u.isalpha())]
        if self.apart:
            between, mark = self.apart
            odd, rest = [u for u in rest if "<|" in u], [u for u in rest if "<|" not in u]
            for k in range(0, len(rest), 256):
                part = rest[k : k + 256]
                ids = np.array(self.tok.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, self.id_type)
                cut = np.flatnonzero(ids == mark)
                if len(cut) == len(part) - 1:
                    raw, w = ids.tobytes(), self.id_type.itemsize
                    begin, end = [0, *((cut + 1) * w).tolist()], [*(cut * w).tolist(), len(raw)]
                    self.known.update(zip(part, (raw[a:b] for a, b in zip(begin, end))))
                else:
                    self.known.update(zip(part, self.whole(part)))
            rest = odd
        self.known.update(zip(rest, self.whole(rest)))

    def pool(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct words in order, and each word's offsets in them."""
        ascii_ = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<|")))
        low = pc.replace_substring_regex(pc.ascii_lower(distinct), r"([a-z])([.,;:!?])", r"\1 \2")
        flat, at = words.split(pc.if_else(ascii_, low, distinct))
        code, units = words.encode(flat)
        names = units.to_pylist()
        if len(self.known) > self.KEEP:  # what is in use just now stays
            self.known = {u: self.known[u] for u in names if u in self.known}
        raw = list(map(self.known.get, names))
        new = [i for i, x in enumerate(raw) if x is None]
        self.learn([names[i] for i in new])
        for i in new:
            raw[i] = self.known[names[i]]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // self.id_type.itemsize
        ids, bound = gather(np.frombuffer(b"".join(raw), self.id_type), np.concatenate([[0], np.cumsum(size)]), code)
        return ids, bound[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, the end id after each, and each text's offsets in them; a null text counts as empty."""
        texts = pc.fill_null(texts, "")
        if self.by_words:
            flat, at = words.split(texts)
            code, distinct = words.encode(flat)
            ids, bound = gather(*self.pool(distinct), code)
            bound = bound[at]
        else:
            raw = self.whole(texts.to_pylist())
            ids = np.frombuffer(b"".join(raw), self.id_type)
            bound = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]) // self.id_type.itemsize
        return np.insert(ids, bound[1:], self.id_type.type(self.end_id)), bound + np.arange(len(bound))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This process's encoder of a tokenizer file.

    Workers live on from task to task, and what the library takes for one more
    tokenizer is not all given back, so a worker makes one and keeps it (the last one, if files differ).
    """
    file = os.stat(path)
    key = path, end_id, file.st_mtime_ns, file.st_size
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def gather(values: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each coded run one after the other, and the runs' offsets."""
    n = np.diff(offsets)[code] if len(code) else np.zeros(0, np.int64)
    stop = np.cumsum(n)
    if not len(n):
        return values[:0], np.zeros(1, np.int64)
    return values[np.arange(int(stop[-1])) + np.repeat(offsets[code] - (stop - n), n)], np.concatenate([[0], stop])


def key_hash(keys: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed)
    return words.mix(words.mix(np.where(null, np.uint64(0x9E3779B97F4A7C15), x) + np.uint64(seed)) + null.astype(np.uint64))


def place(h: np.ndarray, displ: np.ndarray, n: int) -> np.ndarray:
    """Slot of a hashed key under its bucket's displacement."""
    return (words.mix(h + displ.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(max(n, 1))).astype(np.int64)


def build_mph(keys: np.ndarray, null: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Displacement hash (hash and displace, largest buckets first): seed, displacements, each key's slot, fingerprints."""
    n = len(keys)
    buckets = max(1, -(-n // LOAD))
    for seed in range(1, 100):
        h = key_hash(keys, null, seed)
        b = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        count = np.bincount(b, minlength=buckets)
        at = np.concatenate([[0], np.cumsum(count)])
        displ, slot, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(max(n, 1), bool)
        whole = True
        for k in np.argsort(-count, kind="stable"):
            if not count[k]:
                break
            own = order[at[k] : at[k + 1]]
            hk = h[own]
            step, base = (64 if count[k] > 1 else 512), 0
            while base < 1 << 24:
                tries = np.arange(base, base + step, dtype=np.uint64)
                s = place(hk[None, :], tries[:, None], n)
                good = ~taken[s].any(axis=1)
                if len(own) > 1:
                    o = np.sort(s, axis=1)
                    good &= (np.diff(o, axis=1) != 0).all(axis=1)
                if good.any():
                    j = int(np.argmax(good))
                    displ[k], slot[own] = base + j, s[j]
                    taken[s[j]] = True
                    break
                base += step
                step = min(step * 2, 1 << 15)
            else:
                whole = False
                break
        if whole:
            return seed, displ, slot, (words.mix(h ^ np.uint64(0x5BD1E995)) >> np.uint64(32)).astype(np.uint32)
    raise RuntimeError("no displacement found; keys are not distinct")


def index(keys: np.ndarray, null: np.ndarray, size: np.ndarray, width: int) -> bytes:
    """The index of one shard; keys ascending (nulls first), repeated keys side by side, size in ids."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(fresh)
    seed, displ, slot, mark = build_mph(keys[first], null[first])
    table = np.zeros(len(first), SLOT)
    table["mark"][slot], table["first"][slot] = mark, first
    table["count"][slot] = np.diff(np.concatenate([first, [len(keys)]]))
    head = HEAD.pack(MAGIC, width, len(keys), int(size.sum()), len(first), len(displ), seed)
    return b"".join([head, np.cumsum(size).astype("<u8").tobytes(), displ.astype("<u4").tobytes(), table.tobytes()])


class Shard:
    """Keyed access to one shard: its index in memory, its payload (anything with ``read_at``) read by offset."""

    def __init__(self, raw: bytes, payload) -> None:  # noqa: ANN001
        magic, self.width, self.n_docs, self.n_ids, self.n_keys, buckets, self.seed = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.ends = np.frombuffer(raw, "<u8", self.n_docs, at)
        self.displ = np.frombuffer(raw, "<u4", buckets, at := at + 8 * self.n_docs)
        self.slots = np.frombuffer(raw, SLOT, self.n_keys, at + 4 * buckets)
        self.payload = payload

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; (-1, 0) for a key that isn't here."""
        if not self.n_keys:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        h = key_hash(keys, null, self.seed)
        s = self.slots[place(h, self.displ[(h % np.uint64(len(self.displ))).astype(np.int64)], self.n_keys)]
        ok = s["mark"] == (words.mix(h ^ np.uint64(0x5BD1E995)) >> np.uint64(32)).astype(np.uint32)
        return np.where(ok, s["first"].astype(np.int64), -1), np.where(ok, s["count"].astype(np.int64), 0)

    def spans(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each document begin and end."""
        ends = self.ends.astype(np.int64)
        return np.where(docs > 0, ends[docs - 1], 0), ends[docs]

    def ids(self, begin: int, end: int) -> np.ndarray:
        raw = self.payload.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        f, c = self.find(np.array([key or 0]), np.array([key is None]))
        begin, end = self.spans(np.arange(f[0], f[0] + c[0])) if c[0] else ((), ())
        return [self.ids(a, z) for a, z in zip(begin, end)]

    def checksums(self, begin: np.ndarray, end: np.ndarray) -> list[int]:
        """CRC-32 of each span's ids as 32-bit numbers; neighbouring spans are read together, READ_IDS at a time."""
        out = [0] * len(begin)
        order = np.argsort(begin, kind="stable").tolist()
        block, low = np.zeros(0, np.uint32), 0
        for k in order:
            a, z = int(begin[k]), int(end[k])
            while a < z:
                if not low <= a < low + len(block):
                    block, low = self.ids(a, min(self.n_ids, a + READ_IDS)).astype("<u4"), a
                upto = min(z, low + len(block))
                out[k] = zlib.crc32(block[a - low : upto - low].tobytes(), out[k])
                a = upto
        return out


def file_system(uri: str):
    """pyarrow's file system for a URI or plain path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:07d}"


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One shard a task; ids go to the payload as they are made, only key and length of each document are held."""
    from pyspark import TaskContext

    shard, enc = TaskContext.get().partitionId(), None
    keys, null, size = [], [], []
    store, base = file_system(folder)
    path, own = shard_path(base, shard), f"{base}/.{shard:07d}-{uuid.uuid4().hex}"
    out = None
    for b in words.chunks(batches):
        if out is None:
            enc = encoder(tokenizer, end_id)
            store.create_dir(base, recursive=True)
            out = store.open_output_stream(own + ".ids")
        k = b.column("key")
        null.append(pc.is_null(k).to_numpy(zero_copy_only=False))
        keys.append(pc.fill_null(k, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, bound = enc.encode(b.column("text"))
        size.append(np.diff(bound))
        out.write(ids.tobytes())
    if out is None:
        return
    out.close()
    ks, ns, n = np.concatenate(keys), np.concatenate(null), np.concatenate(size)
    with store.open_output_stream(own + ".idx") as f:
        f.write(index(ks, ns, n, enc.id_type.itemsize))
    for part in (".ids", ".idx"):
        store.move(own + part, path + part)
    ends = [None if z else int(k) for k, z in ((ks[0], ns[0]), (ks[-1], ns[-1]))]
    row = [shard, len(ks), int(n.sum()), *ends]
    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=[c.split()[0] for c in MANIFEST.split(", ")])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, write the shards below ``folder`` and return the manifest, one row a shard.

    Null texts count as empty, a null key sorts first, rows with one key stay
    side by side in an order of their texts' hashes (equal texts have equal ids),
    an empty table gives no shard, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(-(-n // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_BYTES)), 1)
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    # a row of five numbers a shard, which the router takes to the driver anyway
    made = rows.mapInArrow(lambda it: _write_shards(it, folder, tokenizer, end_id), MANIFEST).toArrow()
    return spark.createDataFrame(made.to_pylist(), MANIFEST)


def _look_up(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Every asked key of a shard, looked up through its perfect hash."""
    store, root = file_system(folder)
    held: tuple[int, Shard | None] = (-1, None)
    for b in batches:
        if not b.num_rows:
            continue
        shard, base, key = b.column("shard").to_numpy(), b.column("base").to_numpy(), b.column("key")
        null = pc.is_null(key).to_numpy(zero_copy_only=False)
        ks = pc.fill_null(key, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, z in zip(cuts, cuts[1:]):
            if held[0] != shard[a]:
                if held[1] is not None:
                    held[1].payload.close()
                path = shard_path(root, int(shard[a]))
                with store.open_input_stream(path + ".idx") as f:
                    held = (int(shard[a]), Shard(f.read(), store.open_input_file(path + ".ids")))
            s = held[1]
            first, count = s.find(ks[a:z], null[a:z])
            # a key may have many documents: what is found leaves in bounded parts
            total = np.concatenate([[0], np.cumsum(count)])
            for low in range(0, int(total[-1]), 10_000):
                i = np.arange(low, min(low + 10_000, int(total[-1])))
                who = np.searchsorted(total, i, "right") - 1
                begin, end = s.spans(first[who] + i - total[who])
                yield pa.RecordBatch.from_arrays([key.take(pa.array(who + a)), pa.array(begin + base[a], pa.int64()), pa.array(end - begin, pa.int64()), pa.array(s.checksums(begin, end), pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Look each distinct key up: one row per stored document of that key, with where its ids start in the whole set.

    The router (four longs a shard) is the only thing that travels to all tasks.
    A key that was never written gives no row; one that stands in several shards is asked of each.
    """
    spark = keys.sparkSession
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct()
    route = manifest.toArrow().sort_by("shard")
    if not route.num_rows:
        return asked.limit(0).select(F.col("key").alias(key), *[F.lit(None).cast("long").alias(c) for c in ("start", "n_tokens", "ids_crc32")])
    n_ids = route.column("n_ids").to_numpy()
    none_first, none_last = (int(route.column(c).null_count) for c in ("first_key", "last_key"))  # nulls sort first
    low, high = (pc.fill_null(route.column(c), -(1 << 63)).to_numpy() for c in ("first_key", "last_key"))
    sent = spark.sparkContext.broadcast((route.column("shard").to_numpy(), np.cumsum(n_ids) - n_ids, low, high))

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, base, low, high = sent.value
        for b in batches:
            k = pc.fill_null(b.column("key"), 0).to_numpy(zero_copy_only=False)
            null = pc.is_null(b.column("key")).to_numpy(zero_copy_only=False)
            a = np.where(null, 0, none_last + np.searchsorted(high[none_last:], k, "left"))
            z = np.where(null, none_first, np.searchsorted(low, k, "right"))
            n = np.maximum(z - a, 0)
            who = np.repeat(np.arange(len(k)), n)
            at = a[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(who)), pa.array(shard[at]), pa.array(base[at])], names=["key", "shard", "base"])

    routed = asked.mapInArrow(to_shard, "key long, shard long, base long")
    routed = routed.repartition("shard").sortWithinPartitions("shard", "key")
    return routed.mapInArrow(lambda it: _look_up(it, folder), "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read through the index of the files just written.

    Null, empty and repeated texts and ids are handled as in ``write``: each row
    gives a row, a null text has the end id alone, an empty table gives none.
    """
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def store_and_read(docs: DataFrame) -> DataFrame:
    """Pipeline stage: shards of all documents are written below the shared folder, and every row's place is read back from them.

    One row a document, repeated rows and null ids included; columns other than doc_id and text are ignored.
    """
    import public_tokenizers

    folder = durable.new_path(docs.sparkSession, "tokens")
    manifest = write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_back(manifest, folder, docs)

"""Encoding into the pieces of a SentencePiece model with spans in the source text, and decoding.

Normalisation. The model's compiled character map is a double-array trie over
UTF-8 bytes. At every position the longest rule that is a prefix of what is left
gives its replacement, any other character stands for itself; white space is then
escaped, folded and prefixed as the model says. Each normalised character keeps the
byte of the source at which its rule began, so every piece, however often it was
rewritten, is projected to the bytes ``begins[k]`` to ``ends[k]`` (exclusive) of
the text as it came.

Encoding. Merging goes from the best-scored pair of neighbours on, the leftmost of
equals first. Where no piece of the model holds a word mark behind another
character - the tables say so when they are built, other models are refused - no
merge crosses the beginning of a word. So words are encoded by themselves, those that are new to
a Python worker many at once, and it remembers up to ``REMEMBERED`` of them and those in use. Long words merge by
a heap. Characters without a piece become byte pieces, of which the last has the span.

At scale: one pass without a shuffle; texts go through in Arrow batches of
bounded bytes, the model (half a MB, of a constant size) is broadcast. A task that
is lost is run again from its input.

Defined results
* null or empty text: no pieces. Null ``ids``: decode to the empty text.
* very long text: encoded whole; a word of any length has the same pieces as in the library.
* repeated rows, ties, null ids: each row by itself. Empty table: empty result.
* extra columns: kept, whatever their names; own names get underscores where they clash.
* ids outside the vocabulary can't be decoded: an error. Byte pieces that aren't
  UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import beside, for_python, row_of, table

MARK = "▁"
#: Words of which a worker keeps the pieces, besides those of the batch it is at; words of this module's HEAP characters or more aren't kept.
REMEMBERED = 300_000
#: A word of more characters is merged by a heap.
HEAP = 48
_NEVER = float("-inf")
#: Words that are merged together; the rank of what doesn't merge.
TOGETHER, _NO_PAIR = 20_000, 1 << 30


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled character map: a double-array trie, and replacements that end with a NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        # Bytes with which a rule can begin.
        self.first = {b for b in range(256) if self._step(0, b) is not None} if self.units else set()

    def _step(self, node: int, byte: int) -> int | None:
        """The child of a node, None without one. A unit holds an offset (bits 10 up, shifted by 8 if bit 9 is set), bit 8 for a value below, a label."""
        unit = self.units[node]
        child = node ^ ((unit >> 10) << ((unit & 512) >> 6)) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """The replacement of the longest rule that ``data`` has at ``at``, and the bytes it takes."""
        if data[at] not in self.first:
            return None
        node, found, k = 0, None, at
        while k < len(data) and (node := self._step(node, data[k])) is not None:
            k += 1
            unit = self.units[node]
            if unit & 256:
                found = (self.units[node ^ ((unit >> 10) << ((unit & 512) >> 6))] & 0x7FFFFFFF, k - at)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[0])
        return self.texts[found[0] : end].decode(), found[1]


class Normaliser:
    """White space and characters as a model wants them, each with the byte of the source it comes from."""

    def __init__(self, charsmap: bytes, prefix: bool, fold: bool):
        self.map, self.prefix, self.fold = CharacterMap(charsmap), prefix, fold

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its characters, and its end, the byte of the source."""
        data = text.encode("utf-8", "replace")
        if not text or self.fold or not self.map.first.isdisjoint(data):
            return self._by_rules(data)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)
        heads = [0, 0] if self.prefix else [0]
        return MARK * self.prefix + text.replace(" ", MARK), np.concatenate([heads, ends])

    def _by_rules(self, data: bytes) -> tuple[str, np.ndarray]:
        out, starts, at, spaced, begun = [], [], 0, self.fold, False
        while at < len(data):
            if (rule := self.map.longest(data, at)) is None:
                lead = data[at]
                taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                rule = data[at : at + taken].decode(), taken
            new = rule[0].lstrip(" ") if spaced else rule[0]
            if not begun and (new or not self.fold):
                begun = True
                out, starts = [MARK] * self.prefix, [at] * self.prefix
            out.extend(MARK if c == " " else c for c in new)
            starts.extend([at] * len(new))
            if self.fold and new:
                spaced = new.endswith(" ")
            at += rule[1]
        while self.fold and out and out[-1] == MARK:
            out.pop()
            at = starts.pop()
        return "".join(out), np.array([*starts, at] if begun else [0], np.int64)


class PairTable:
    """All pairs of symbols that merge, as arrays, and the merging of many short words at once.

    Symbols are pieces, and characters that stand in pieces without being one. In every round each
    word merges its best pair, the leftmost of equals, and only the pairs beside it are looked up again.
    """

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        symbols = {piece: k for k, piece in enumerate(scores)}
        for c in sorted({c for piece in scores for c in piece} - set(symbols)):
            symbols[c] = len(symbols)
        # Id in the model, or -1 for symbols that become bytes.
        self.model_ids = np.array([ids.get(text, -1) for text in symbols], np.int64)
        rank = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.n = len(symbols)
        pairs = [(symbols[p[:k]] * self.n + symbols[p[k:]], rank[score], symbols[p]) for p, score in scores.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.codes, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.ranks, self.merged = self.ranks.astype(np.int32), self.merged.astype(np.int32)
        singles = sorted((ord(t), k) for t, k in symbols.items() if len(t) == 1)
        self.points, self.of_points = (np.array(x, np.int64) for x in zip(*singles, strict=True))

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NO_PAIR`` if it doesn't merge) and the symbol that it becomes."""
        code = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return np.where(hit, self.ranks[at], _NO_PAIR), self.merged[at]

    def segments(self, words: list[str]) -> list[bytes]:
        """``Pieces.segment`` of each word."""
        if not words or not len(self.codes):
            return [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbol = np.where(self.points[at] == points, self.of_points[at], -1).astype(np.int32)
        word, place = np.repeat(np.arange(len(words), dtype=np.int32), sizes), np.arange(len(points), dtype=np.int32)
        rank, becomes = np.full(len(points), _NO_PAIR, np.int32), np.zeros(len(points), np.int32)
        rank[:-1], becomes[:-1] = self._looked_up(symbol[:-1], symbol[1:])
        rank[np.cumsum(sizes) - 1] = _NO_PAIR
        done = []
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(rank)), first)
            open_words = (best >> 32) < _NO_PAIR
            spot = best[open_words] & 0xFFFFFFFF
            keep = np.ones(len(symbol), bool)
            if not open_words.all():
                # Words without a pair are done and leave the arrays.
                keep = np.repeat(open_words, np.diff(first, append=len(word)))
                done.append((place[~keep], symbol[~keep]))
            # The right one of each pair goes, the left one becomes the pair and takes the right one's place in the word.
            symbol[spot] = becomes[spot]
            keep[spot + 1] = False
            symbol, word, place, rank, becomes = (x[keep] for x in (symbol, word, place, rank, becomes))
            spot = (np.cumsum(keep) - 1)[spot]
            for left in (spot - 1, spot):
                left = left[(left >= 0) & (left + 1 < len(symbol))]
                found, into = self._looked_up(symbol[left], symbol[left + 1])
                rank[left], becomes[left] = np.where(word[left] == word[left + 1], found, _NO_PAIR), into
            if len(spot) and spot[-1] == len(symbol) - 1:
                rank[-1] = _NO_PAIR
        place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        place, symbol = place[order].astype(np.int64), symbol[order]
        return self._written(points, place, symbol, np.diff(place, append=len(points)), sizes)

    def _written(self, points, place, symbol, chars, sizes) -> list[bytes]:
        """(id, characters) of all symbols, characters without a piece as bytes, cut at the ends of the words."""
        ids = np.where(symbol >= 0, self.model_ids[symbol], -1)
        plain = ids >= 0
        code = points[place]
        count = np.where(plain, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        begin = np.cumsum(count) - count
        out = np.zeros((int(count.sum()), 2), "<i4")
        out[begin[plain], 0], out[begin[plain], 1] = ids[plain], chars[plain]
        code, count, begun = code[~plain], count[~plain], begin[~plain]
        for k in range(4):
            has = count > k
            shift = 6 * (count[has] - 1 - k)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[count[has]] if k == 0 else 0x80
            byte = (code[has] >> shift & np.where(k == 0, 0xFF, 0x3F)) | lead
            out[begun[has] + k, 0] = self.byte_ids[byte]
        out[begun + count - 1, 1] = 1
        ends = np.searchsorted(place, np.cumsum(sizes))
        cuts = [0, *np.append(begin, len(out))[ends].tolist()]
        data = out.tobytes()
        return [data[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Pieces:
    """A model's tables. Merging models with byte pieces and escaped spaces only; others are refused."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        trainer, rules = proto.trainer_spec, proto.normalizer_spec
        kinds = schema.ModelProto.SentencePiece
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not rules.escape_whitespaces or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only merging models with byte pieces and word marks in front are read")
        self.scores, self.ids, self.byte_ids, self.texts, self.kinds = {}, {}, [0] * 256, [], []
        for k, p in enumerate(proto.pieces):
            if p.type in (kinds.USER_DEFINED, kinds.UNUSED) or (p.type == kinds.NORMAL and MARK in p.piece.lstrip(MARK)):
                raise ValueError(f"pieces like {p.piece!r} aren't read")
            self.kinds.append(p.type)
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                self.texts.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = k, p.score
                self.texts.append(p.piece.replace(MARK, " ").encode())
            else:
                self.texts.append((trainer.unk_surface or " ⁇ ").encode() if p.type == kinds.UNKNOWN else b"")
        self.byte, self.normal = kinds.BYTE, kinds.NORMAL
        # Pieces that end a stretch of bytes without being text of their own.
        self.silent = {k for k, t in enumerate(self.kinds) if t == kinds.CONTROL}
        self.prefix, self.fold = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.normalise = Normaliser(rules.precompiled_charsmap, self.prefix, self.fold)
        self.table = PairTable(self.scores, self.ids, self.byte_ids)
        # Pieces by word, without the mark in front of it: pairs of 32-bit numbers (id, characters), as bytes.
        self.words: dict[str, bytes] = {}

    def merged(self, word: str) -> list[str]:
        """A word's characters, merged from the best-scored pair on."""
        parts, scores = list(word), self.scores
        if len(parts) > HEAP:
            return self._merged_by_heap(parts)
        pairs = [scores.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) != _NEVER:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = scores.get(parts[at - 1] + parts[at], _NEVER)
            if at < len(pairs):
                pairs[at] = scores.get(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _merged_by_heap(self, parts: list[str | None]) -> list[str]:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        pairs = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts) and (score := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(pairs, (-score, a, b, parts[a], parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while pairs:
            _, a, b, left, right = heapq.heappop(pairs)
            if parts[a] != left or parts[b] != right or after[a] != b:
                continue
            parts[a], parts[b] = left + right, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def segment(self, word: str) -> bytes:
        """(id, characters) of each piece of a stretch that no merge leaves; byte pieces but the last have no characters."""
        out: list[int] = []
        for part in self.merged(word):
            if (k := self.ids.get(part)) is not None:
                out += k, len(part)
            else:
                for b in part.encode("utf-8", "replace"):
                    out += self.byte_ids[b], 0
                out[-1] = 1
        return struct.pack(f"<{len(out)}i", *out)

    @staticmethod
    def parted(normal: str) -> tuple[str, list[str]]:
        """What stands in front of the first mark of a normalised text, and its words: a key stands for a mark and itself."""
        head, *keys = normal.split(MARK)
        if "" in keys:  # Runs of marks: all of them belong to the word behind them.
            runs, keys, marks = keys, [], 0
            for key in runs:
                if key:
                    keys.append(MARK * marks + key)
                marks = 0 if key else marks + 1
            if marks:
                keys.append(MARK * (marks - 1))
        return head, keys

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the bytes of the text at which each piece begins and ends."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of several texts; words that are new to the worker are merged together."""
        normal = [self.normalise(t) if t else ("", None) for t in texts]
        parts = [self.parted(n) for n, _ in normal]
        used = set(chain.from_iterable(keys for _, keys in parts))
        new = [k for k in used if k not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {k: self.words[k] for k in used if k in self.words}
        short, long = [k for k in new if len(k) < HEAP], [k for k in new if len(k) >= HEAP]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            self.words.update(zip(some, self.table.segments([MARK + k for k in some]), strict=True))
        self.words.update((k, self.segment(MARK + k)) for k in long)
        out = []
        for (n, source), (head, keys) in zip(normal, parts, strict=True):
            if not n:
                out.append((np.zeros(0, np.int32),) * 3)
                continue
            found = np.frombuffer((self.segment(head) if head else b"") + b"".join(map(self.words.__getitem__, keys)), "<i4").reshape(-1, 2)
            ends = np.cumsum(found[:, 1])
            out.append((found[:, 0], source[ends - found[:, 1]].astype(np.int32), source[ends].astype(np.int32)))
        for k in long:
            del self.words[k]
        return out

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        ids = [] if ids is None else list(ids)
        parts = [self.texts[k] for k in ids] if not ids or min(ids) >= 0 else [self.texts[k] if k >= 0 else self.texts[len(self.texts)] for k in ids]
        if self.prefix or self.fold:
            for k, part in enumerate(parts):
                if part and self.kinds[ids[k]] != self.normal:
                    break  # Bytes, or a stand-in for something unknown.
                if part.startswith(b" "):
                    parts[k] = part[1:]
                    if parts[k] or not self.fold:
                        break
                elif part:
                    break
        if self.silent.isdisjoint(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out = []
        for is_byte, run in groupby(zip(ids, parts, strict=True), lambda x: self.kinds[x[0]] == self.byte):
            data = b"".join(p for _, p in run)
            out.append(_read_bytes(data) if is_byte else data.decode())
        return "".join(out)


def _read_bytes(data: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that isn't part of a whole character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def pieces_of(model: bytes) -> Pieces:
    """One set of tables, and of remembered words, for all tasks of a worker."""
    return Pieces(model)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by ``ids``, ``begins`` and ``ends`` (arrays of int) of its pieces."""
    spark = docs.sparkSession
    for_python(spark)
    with open(model or model_path(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    lean = docs.select(row_of(docs, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        pieces = pieces_of(sent.value)
        for batch in batches:
            found = pieces.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[_lists([f[k] for f in found]) for k in range(3)]], ["row", "ids", "begins", "ends"])

    schema = StructType([lean.schema["row"]])
    for name in ("ids", "begins", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return beside(lean.mapInArrow(run, schema), [c for c in docs.columns if c != text_col], ["ids", "begins", "ends"])


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of its ids."""
    spark = encoded.sparkSession
    for_python(spark)
    with open(model or model_path(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    lean = encoded.select(row_of(encoded, ids_col).alias("row"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches):
        pieces = pieces_of(sent.value)
        for batch in batches:
            ids = batch.column(1)
            texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else None) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    found = lean.mapInArrow(run, StructType([*lean.schema]).add("decoded", StringType()))
    own = "decoded"
    while own in encoded.columns:
        own += "_"
    return found.select(*[F.col("ids").alias(c) if c == ids_col else F.col("row").getField(c).alias(c) for c in encoded.columns], F.col("decoded").alias(own))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: their digests, the digest of the decoded text, and the byte at which the last span ends."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_span_bytes"),
        "ids",
    )
    return decode(found).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_span_bytes")

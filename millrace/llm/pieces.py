"""SentencePiece encoding and decoding of texts with a BPE model, by merge rounds over flat arrays.

A text is normalised as the model says (blanks become U+2581, one is put in front), cut into words of
blanks and characters of one kind (those that pieces have side by side, directly or by others), and cut further between characters
that no piece has side by side: no piece goes over such a place, so each segment is merged by itself. The symbols of many segments lie in one array. A round finds in each
segment the pair whose piece has the best score, merges its places at once, the leftmost of those that overlap,
closes the gaps and looks up the pairs that changed, until no segment has a pair left. The library merges one pair at a
time, the best first, ties from the left. Merging all places at once is the same unless a merge can make a pair that
is at least as good, which is when the piece begins or ends a piece that is no worse; of such a piece (known from the
model) a round merges the first place alone. Segments of more than LONG symbols, which would take as many rounds, go
through a heap in the same order of merges. A task remembers the words it met, up to a bound of characters.

What the model has no piece for becomes the pieces of its bytes. Null and empty texts give no ids; texts are whole,
however long; bytes that are no UTF-8 count as U+FFFD. Ids decode as the library does it: control ids to nothing,
byte pieces that are no UTF-8 to U+FFFD each, null ids lists to null; an id that the model does not have is an
error. Both are columns made of a column, so other columns, their names, repeated rows and empty tables don't matter.
Models with another algorithm, character maps, user-defined or unused pieces, or pieces across words, are errors.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
BLANK = "\u2581"
#: The kinds of pieces, and the algorithm, as the file numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: A code for each character that is no piece follows the pieces' ids.
CHARACTERS = 0x110000
#: Symbols of a segment from which on it is merged with a heap.
LONG = 256
#: Characters of texts that are encoded at a time, and of words that a task remembers.
GROUP, REMEMBERED = 1 << 18, 1 << 22
NEVER = np.iinfo(np.int32).max

codecs.register_error("millrace-each-byte", lambda e: ("\ufffd", e.start + 1))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 0x80:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            n, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start, length of them, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Model:
    """A BPE model: its pieces, and tables of the pairs that make them."""

    def __init__(self, data: bytes):
        texts, scores, kinds, specs = [], [], [], {}
        for number, value in message(data):
            if number == 1:
                piece = dict(message(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif isinstance(value, bytes):
                specs[number] = dict(message(value))
        trainer, normalizer, denormalizer = (specs.get(i, {}) for i in (2, 3, 5))
        plain = not normalizer.get(2) and not denormalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        known = set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} and not any(BLANK in t.lstrip(BLANK) for t, k in zip(texts, kinds) if k == NORMAL)
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not plain or not known:
            raise ValueError("only BPE models with byte pieces, without character maps, user-defined pieces or pieces across words")
        self.texts, self.prefix, self.size = texts, bool(normalizer.get(3, 1)), len(texts)
        self.span = self.size + CHARACTERS
        ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
        self.bytes = {int(t[3:-1], 16): i for i, (t, k) in enumerate(zip(texts, kinds)) if k == BYTE}
        # ranks by score, the best 0; pieces of one score share a rank
        _, order = np.unique(-np.array(scores), return_inverse=True)
        self.rank = order.astype(np.int32)
        self.symbol = np.arange(self.size, self.span, dtype=np.int64)
        for t, i in ids.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
        self.early = np.zeros(int(self.rank.max()) + 1, dtype=bool)
        number = lambda t: ids.get(t, self.size + ord(t) if len(t) == 1 else None)
        keys, made, beside = [], [], set()
        for t, i in ids.items():
            beside.update(zip(t, t[1:]))
            for k in range(1, len(t)):
                left, right = number(t[:k]), number(t[k:])
                if left is not None and right is not None:
                    keys.append(left * self.span + right)
                    made.append(i)
                for part in (left, right):
                    if part is not None and part < self.size and self.rank[part] >= self.rank[i]:
                        self.early[self.rank[part]] = True
        keys, made = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.beside = np.array(sorted(ord(a) * CHARACTERS + ord(b) for a, b in beside), dtype=np.int64)
        self.kind = self._kinds(beside)
        unknown = trainer.get(44, " ⁇ ".encode())
        surface = {UNKNOWN: lambda i: unknown, CONTROL: lambda i: b"", BYTE: lambda i: bytes([int(texts[i][3:-1], 16)])}
        self.surface = [surface[k](i) if k in surface else texts[i].replace(BLANK, " ").encode() for i, k in enumerate(kinds)]
        self.kinds = kinds
        lengths = np.array([len(x) for x in self.surface])
        self.surface_bytes, self.surface_ends = np.frombuffer(b"".join(self.surface), dtype=np.uint8), np.cumsum(lengths)
        self.surface_lengths = lengths
        ascii_byte = [k == BYTE and self.surface[i] < b"\x80" for i, k in enumerate(kinds)]
        self.plain = np.array([k in (NORMAL, UNKNOWN) for k in kinds]) | np.array(ascii_byte)
        self.blank_first = np.array([k == NORMAL and x[:1] == b" " for k, x in zip(kinds, self.surface)])
        random = np.random.default_rng(0)
        self.values = random.integers(0, 1 << 63, CHARACTERS, dtype=np.uint64)
        self.powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
        self.forget()

    @staticmethod
    def _kinds(beside: set[tuple[str, str]]) -> np.ndarray:
        """The kind of each character: those that pieces connect are of one kind; the others are of none (0), blanks are 1."""
        kind: dict[str, str] = {}

        def of(c: str) -> str:
            while kind.setdefault(c, c) != c:
                kind[c] = c = kind[kind[c]]
            return c

        for a, b in beside:
            if BLANK not in (a, b):
                kind[of(a)] = of(b)
        table, numbers = np.zeros(CHARACTERS, dtype=np.int32), {}
        for c in list(kind):
            table[ord(c)] = numbers.setdefault(of(c), len(numbers) + 2)
        table[ord(BLANK)] = 1
        return table

    def pairs(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that pairs of symbols make and their ranks; NEVER where there is none, or they are of two segments."""
        if not len(self.keys):
            return np.zeros(len(left), dtype=np.int64), np.full(len(left), NEVER, dtype=np.int32)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[at]
        return made, np.where(same & (self.keys[at] == key), self.rank[made], NEVER)

    def segments(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of the segment of each character; words begin at starts."""
        begins = np.ones(len(codes), dtype=np.int64)
        if len(self.beside):
            key = codes[:-1] * CHARACTERS + codes[1:]
            at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            begins[1:] = self.beside[at] != key
        begins[starts] = 1
        return np.cumsum(begins) - 1

    def merge(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the segments, and their segments, when no pair is left."""
        done = []
        made, rank = self.pairs(symbol, np.append(symbol[1:], 0), np.append(segment[1:] == segment[:-1], False))
        while len(symbol):
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            size = np.diff(np.append(first, len(segment)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            live = best != NEVER
            if not live.all():
                done.append((symbol[~live], segment[~live]))
                symbol, segment, made, rank, best = (x[live] for x in (symbol, segment, made, rank, best))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            begins = np.append(True, np.diff(hit) != 1)
            run = hit[begins][np.cumsum(begins) - 1]
            hit = hit[(hit - run) % 2 == 0]
            alone = np.append(True, segment[hit[1:]] != segment[hit[:-1]])
            hit = hit[alone | ~self.early[best[hit]]]
            symbol[hit] = made[hit]
            kept = np.ones(len(symbol), dtype=bool)
            kept[hit + 1] = False
            at = (np.cumsum(kept) - 1)[hit]
            symbol, segment, made, rank = (x[kept] for x in (symbol, segment, made, rank))
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(symbol) - 1)
            same = (segment[changed] == segment[after]) & (after > changed)
            made[changed], rank[changed] = self.pairs(symbol[changed], symbol[after], same)
        if not done:
            return symbol, segment
        symbol, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(segment, kind="stable")
        return symbol[order], segment[order]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The symbols of one segment when no pair is left, merged one by one."""
        table = self.table()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            if left >= 0 and (right := after[left]) >= 0 and (made := table.get(symbols[left] * self.span + symbols[right])) is not None:
                heapq.heappush(heap, (int(self.rank[made]), left, symbols[left], symbols[right]))

        for i in range(n):
            offer(i)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue
            symbols[left], symbols[right] = table[a * self.span + b], -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [s for s in symbols if s >= 0]

    @lru_cache(maxsize=1)  # noqa: B019 - one model a worker
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.made.tolist()))

    def forget(self) -> None:
        """No word is known: their hashes in order, and by word its characters, its ids, and where both end."""
        self.hashes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.known_codes, self.known_ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.code_ends, self.id_ends = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _powers(self, n: int) -> list[np.ndarray]:
        """The powers of an odd number, and of its inverse, below 2^64."""
        if len(self.powers[0]) < n:
            base = 0x9E3779B97F4A7C15
            for k, x in enumerate((base, pow(base, -1, 1 << 64))):
                steps = np.full(n, x, dtype=np.uint64)
                steps[0] = 1
                self.powers[k] = np.cumprod(steps)
        return self.powers

    def word_starts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin, in texts that begin at starts: blanks and what of one kind follows them."""
        kind = self.kind[codes]
        begins = np.ones(len(codes), dtype=bool)
        now, before = kind[1:], kind[:-1]
        begins[1:] = (before != 1) & ((now != before) | (now == 0))
        begins[1:] &= ~((now == 1) & (before == 1))
        begins[starts] = True
        return np.flatnonzero(begins)

    def distinct(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words, a place of each, and which of them each word is."""
        power, inverse = self._powers(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.values[codes] * power[: len(codes)])])
        hashes = (sums[starts + lengths] - sums[starts]) * inverse[starts]
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # equal hashes are to be equal words; else every word is taken for a word of its own
        other = first[which]
        same = lengths[other] == lengths
        if same.all():
            place = ragged(starts[other], lengths)
            same = codes[place] == codes[ragged(starts, lengths)]
        if not same.all():
            return np.arange(len(starts), dtype=np.uint64), np.arange(len(starts)), np.arange(len(starts))
        return hashes, first, which

    def encode(self, texts: list[str], fronts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and where each text's end; fronts: they get the model's blank."""
        if self.code_ends[-1] > REMEMBERED:
            self.forget()
        front = BLANK if self.prefix and fronts else ""
        given = [front + t if t else "" for t in texts]
        codes = np.frombuffer("".join(given).encode("utf-32-le", "replace"), dtype="<i4").copy()
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        codes[codes == 32] = ord(BLANK)
        return self.encode_codes(codes, np.cumsum([len(t) for t in given]))

    def encode_codes(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text_starts = np.concatenate([[0], ends[:-1]])
        starts = self.word_starts(codes, text_starts[text_starts < ends])
        lengths = np.diff(np.append(starts, len(codes)))
        hashes, first, which = self.distinct(codes, starts, lengths)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        number = self.number[at] if len(self.number) else np.full(len(hashes), -1)
        known = np.zeros(len(hashes), dtype=bool)
        if len(self.number):
            known = (self.hashes[at] == hashes) & (self.code_ends[number + 1] - self.code_ends[number] == lengths[first])
            k = np.flatnonzero(known)  # the characters decide, not the hash
            n = lengths[first[k]]
            same = self.known_codes[ragged(self.code_ends[number[k]], n)] == codes[ragged(starts[first[k]], n)]
            if not same.all():
                known[k[np.repeat(np.arange(len(k)), n)[~same]]] = False
        new = np.flatnonzero(~known)
        if len(new):
            number[new] = len(self.code_ends) - 1 + np.arange(len(new))
            own = ragged(starts[first[new]], lengths[first[new]])
            ids, id_ends = self.learn(codes[own], lengths[first[new]])
            self.known_codes = np.concatenate([self.known_codes, codes[own]])
            self.code_ends = np.concatenate([self.code_ends, self.code_ends[-1] + np.cumsum(lengths[first[new]])])
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + id_ends])
            where = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.number = np.insert(self.hashes, where, hashes[new]), np.insert(self.number, where, number[new])
        word = number[which]
        counts = self.id_ends[word + 1] - self.id_ends[word]
        ids = self.known_ids[ragged(self.id_ends[word], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, ends)]

    def learn(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's end."""
        codes = codes.astype(np.int64)
        segment = self.segments(codes, np.cumsum(lengths) - lengths)
        word_of = np.repeat(np.arange(len(lengths)), lengths)[np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))]
        symbol, size = self.symbol[codes], np.bincount(segment)
        short = size[segment] <= LONG
        symbols, segments = zip(self.merge(symbol[short], segment[short]))
        symbols, segments = list(symbols), list(segments)
        for g in np.flatnonzero(size > LONG).tolist():
            merged = self.merge_long(symbol[segment == g].tolist())
            symbols.append(np.array(merged, dtype=np.int64)), segments.append(np.full(len(merged), g))
        symbol, segment = np.concatenate(symbols), np.concatenate(segments)
        order = np.argsort(segment, kind="stable")
        symbol, word = symbol[order], word_of[segment[order]]
        # what is no piece becomes the pieces of its bytes
        spelt = {int(x): [self.bytes[b] for b in chr(x - self.size).encode()] for x in np.unique(symbol[symbol >= self.size])}
        if spelt:
            codes_of = np.array(sorted(spelt), dtype=np.int64)
            sizes, flat = np.array([len(spelt[x]) for x in codes_of]), np.array([i for x in codes_of for i in spelt[x]])
            which = np.searchsorted(codes_of, symbol)
            other = symbol >= self.size
            n = np.where(other, sizes[np.minimum(which, len(sizes) - 1)], 1)
            out = np.repeat(symbol, n)
            out[np.repeat(other, n)] = flat[ragged((np.cumsum(sizes) - sizes)[which[other]], n[other])]
            symbol, word = out, np.repeat(word, n)
        return symbol.astype(np.int32), np.searchsorted(word, np.arange(len(lengths)), side="right")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of lists of ids, one after the other, and where each text's end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError(f"an id is not among the {self.size} of the model")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        lengths, at = self.surface_lengths[ids], (self.surface_ends - self.surface_lengths)[ids]
        first = starts[starts < ends]  # the blank in front of the text was put there
        cut = first[self.blank_first[ids[first]]] if self.prefix else first[:0]
        lengths[cut] -= 1
        at[cut] += 1
        data = np.concatenate([self.surface_bytes[ragged(at[i : i + GROUP], lengths[i : i + GROUP])] for i in range(0, max(1, len(ids)), GROUP)])
        sums = np.concatenate([[0], np.cumsum(lengths)])
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(~self.plain[ids]), side="right"))
        if not len(odd):
            return data, sums[ends]
        texts, begin = [], 0
        for k in odd.tolist():
            texts += [data[sums[starts[begin]] : sums[starts[k]]].tobytes() if begin < k else b"", self.decode_one(ids[starts[k] : ends[k]].tolist()).encode()]
            begin = k + 1
        texts.append(data[sums[starts[begin]] :].tobytes() if begin < len(ends) else b"")
        size = sums[ends] - sums[starts]
        size[odd] = [len(x) for x in texts[1::2]]
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(size)

    def decode_one(self, ids: list[int]) -> str:
        """A text with control ids, or with bytes beyond ASCII, of which some may be no character."""
        surface, kinds = self.surface, self.kinds
        raw = [surface[i] for i in ids]
        for k, i in enumerate(ids):
            if kinds[i] != CONTROL:
                if self.prefix and self.blank_first[i]:
                    raw[k] = raw[k][1:]
                break
        ends = [k for k, i in enumerate(ids) if kinds[i] == CONTROL]  # bytes on both sides make no character
        runs = [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)])]
        return "".join([b"".join(run).decode("utf-8", "millrace-each-byte") for run in runs])


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model(data)


def _shared(spark: SparkSession, path: str) -> Callable[[], Model]:
    with open(path, "rb") as file:  # a few megabytes, on the driver's machine
        data = file.read()
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    Model(data)  # a model of another kind is an error here, not in a task
    shared = spark.sparkContext.broadcast(data)
    return lambda: _model(shared.value)


def _chunks(text: str) -> Iterator[str]:
    """A text in parts that begin with a blank behind another character, where a word ends, each some GROUP characters."""
    begin = 0
    while len(text) - begin > GROUP:
        at = text.find(" ", begin + GROUP)
        while at > 0 and text[at - 1] in (" ", BLANK):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


def encode_array(model: Model, texts: pa.Array) -> pa.Array:
    """The ids of each of the texts (binary), some GROUP characters at a time."""
    values, counts, group, size = [], np.zeros(len(texts), dtype=np.int64), [], 0
    of: list[int] = []

    def flush() -> None:
        ids, ends = model.encode(group, front)
        values.append(ids)
        np.add.at(counts, of, np.diff(ends, prepend=0))

    front = True
    for k, x in enumerate(texts):
        raw = x.as_py()
        text = "" if raw is None else raw.decode("utf-8", "millrace-each-byte")
        for n, chunk in enumerate(_chunks(text)):
            if n:  # a part that goes on has no blank put in front
                flush()
                group, of, front = [chunk], [k], False
                flush()
                group, of, size, front = [], [], 0, True
                continue
            group.append(chunk), of.append(k)
            size += len(chunk)
            if size > GROUP:
                flush()
                group, of, size = [], [], 0
    flush()
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.int32()))


def decode_array(model: Model, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids; null for null."""
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    sums, texts, begin = np.cumsum(lengths), [], 0
    while begin < len(ids):  # lists of some GROUP ids at a time
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] - lengths[begin] + GROUP)))
        part = ids.slice(begin, end - begin)
        data, ends = model.decode(part.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths[begin:end]))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        out = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        texts.append(pc.if_else(part.is_valid(), out, pa.scalar(None, pa.string())) if part.null_count else out)
        begin = end
    return pa.concat_arrays(texts) if texts else pa.array([], pa.string())


def encoder(spark: SparkSession, path: str = MODEL) -> Callable[[Column], Column]:
    """A function from a column of texts to one of their ids (array<int>)."""
    model = _shared(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_array(model(), texts)

    return lambda text: encode(text.cast("binary"))


def decoder(spark: SparkSession, path: str = MODEL) -> Callable[[Column], Column]:
    """A function from a column of ids (array<int>) to one of the texts they stand for."""
    model = _shared(spark, path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return decode_array(model(), ids)

    return decode

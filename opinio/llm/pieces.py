"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together: for every length of piece, the
substring hashes of all words are probed in the sorted piece keys at once, and
position by position a vectorised maximum over the pieces that may end there
stores the backpointers.

Two kinds of models are served.  For a unigram model the maximum is over summed
log-probabilities.  For a BPE model the best last piece of each prefix is the
one whose pair with the prefix's own last piece survives the merges; exactly
one piece does, so the same table yields the very ids of the merge procedure.
Pairs are tested by undoing the two pieces' merges in reverse order, all pairs
of a step at once.

The vocabulary file is only read where the model is loaded; tasks receive its
tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import table, text_or_empty

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PIECE_TEXT = 1 << 22        # characters handled at a time within a worker
MEMO = 600_000              # words a worker remembers (only to save time)
PAIRS = 2_000_000           # tested pairs a worker remembers (only to save time)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1 << 40)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's top fields."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i:i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[i:i + n]
            i += n


def _hash_words(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(points.shape[:-1], np.uint64)
    for k in range(points.shape[-1]):
        h = h * _BASE + points[..., k].astype(np.uint64) + np.uint64(1)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class PieceModel:
    proto: bytes
    bpe: bool
    pieces: list
    keys: dict              # length -> (sorted hashes, piece ids)
    score: np.ndarray
    unknown: int
    byte_ids: np.ndarray    # id of each byte's piece, empty without byte fallback
    splittable: bool        # no piece crosses from a word into the next word's space
    joints: np.ndarray      # neighbouring characters that occur inside some piece, as sorted keys
    rank: np.ndarray = field(default=None)      # BPE: place in the order of merges, -1 for a character
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    pair_keys: np.ndarray = field(default=None)
    pair_ranks: np.ndarray = field(default=None)
    usable: np.ndarray = field(default=None)


def merge_words(word: str, rank_of: dict) -> list:
    """Plain merge procedure on one word: [(piece, (left, right) or None)], by rounds."""
    parts = [(c, None) for c in word]
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank_of.get(parts[i][0] + parts[i + 1][0])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        a, b = parts[at][0], parts[at + 1][0]
        parts[at:at + 2] = [(a + b, (a, b))]


def load_pieces(model_file: str = MODEL_FILE) -> PieceModel:
    """Tables of a model file (unigram or BPE) for the batched encoder."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    proto = sp.serialized_model_proto()
    kind = 1
    for number, value in _fields(proto):
        if number == 2:
            kind = next((v for k, v in _fields(value) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models can be loaded")
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
                                          or sp.is_unused(i))]
    score = np.array([sp.get_score(i) for i in range(n)], dtype=np.float64)
    byte_ids = np.array([i for i in range(n) if sp.is_byte(i)], dtype=np.int32)
    by_length: dict[int, list[int]] = {}
    for i in normal:
        by_length.setdefault(len(pieces[i]), []).append(i)
    keys = {}
    for size, ids in by_length.items():
        h = _hash_words(np.stack([_points(pieces[i]) for i in ids]))
        order = np.argsort(h)
        keys[size] = (h[order], np.array(ids, dtype=np.int32)[order])
    m = PieceModel(proto, kind == 2, pieces, keys, score, sp.unk_id(), byte_ids,
                   not any(SPACE in pieces[i].lstrip(SPACE) for i in normal),
                   np.array(sorted({(ord(a) << 32) | ord(b) for i in normal
                                    for a, b in zip(pieces[i], pieces[i][1:])}), dtype=np.int64))
    if m.bpe:
        id_of = {pieces[i]: i for i in normal}
        order = sorted(normal, key=lambda i: (-score[i], i))
        place = {pieces[i]: r for r, i in enumerate(order) if len(pieces[i]) > 1}
        m.rank = np.full(n, -1, np.int64)
        m.left, m.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        m.usable = np.zeros(n, bool)
        for i in normal:
            p = pieces[i]
            if len(p) == 1:
                m.usable[i] = True
                continue
            m.rank[i] = place[p]
            built = merge_words(p, place)
            if len(built) == 1:
                a, b = built[0][1]
                if a in id_of and b in id_of:
                    m.left[i], m.right[i], m.usable[i] = id_of[a], id_of[b], True
        pairs = {}
        for i in normal:
            p = pieces[i]
            for c in range(1, len(p)):
                a, b = id_of.get(p[:c]), id_of.get(p[c:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = place[p]
        k = np.array(sorted(pairs), dtype=np.int64)
        m.pair_keys, m.pair_ranks = k, np.array([pairs[x] for x in k.tolist()], dtype=np.int64)
    return m


class PieceEncoder:
    """Encodes and decodes many texts with one model's tables."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        self.rank_of = ({model.pieces[i]: int(r) for i, r in enumerate(model.rank) if r >= 0}
                        if model.bpe else None)
        self.id_of = {p: i for i, p in enumerate(model.pieces)}
        self.longest = max(model.keys)
        self.memo: dict[str, int] = {}
        self.known = np.array([-1], np.int64)       # tested pairs, sorted
        self.apart = np.zeros(1, bool)
        self.fresh: list = []
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # decoding: the bytes of each piece (a space piece is one space)
        raw = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])

    def _stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart by way of the pairs tested before."""
        key = (a.astype(np.int64) << 32) | b
        p = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        ok = self.apart[p]
        new = np.flatnonzero(self.known[p] != key)
        if len(new):
            keys, at = np.unique(key[new], return_inverse=True)
            got = self._apart(keys >> 32, keys & 0xFFFFFFFF)
            ok[new] = got[at]
            self.fresh.append((keys, got))
        return ok

    def _file_pairs(self) -> None:
        if sum(len(k) for k, _ in self.fresh) * 8 > len(self.known):
            if len(self.known) > PAIRS:
                self.known, self.apart = np.array([-1], np.int64), np.zeros(1, bool)
            keys = np.concatenate([self.known] + [k for k, _ in self.fresh])
            values = np.concatenate([self.apart] + [v for _, v in self.fresh])
            self.known, at = np.unique(keys, return_index=True)
            self.apart, self.fresh = values[at], []

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """BPE: whether pieces a and b stay apart when their texts are merged together."""
        m = self.m
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        tx = np.full(len(a), _FAR)      # when x is merged into its parent
        ty = np.full(len(a), _FAR)
        while len(live):
            key = (x << 32) | y
            p = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            r = np.where(m.pair_keys[p] == key, m.pair_ranks[p], _FAR)
            lost = (r < tx) & (r <= ty)
            ok[live[lost]] = False
            rx, ry = m.rank[x], m.rank[y]
            go = ~lost & ((rx >= 0) | (ry >= 0))
            live, x, y, tx, ty, rx, ry = (v[go] for v in (live, x, y, tx, ty, rx, ry))
            undo = rx > ry              # the later merge is undone first; at a tie the right one
            tx = np.where(undo, rx, tx)
            ty = np.where(undo, ty, ry)
            x = np.where(undo, m.right[x], x)
            y = np.where(undo, y, m.left[y])
        return ok

    def _table(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece (id, -1 unknown character) and its length at each end of each word."""
        m, n = points.shape
        codes = points.astype(np.uint64) + np.uint64(1)
        found = {}
        h = np.zeros((m, n), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, :n - size + 1] * _BASE + codes[:, size - 1:]
            if size in self.m.keys:
                keys, ids = self.m.keys[size]
                p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.where(keys[p] == h, ids[p], -1)
                if self.m.bpe:
                    hit = np.where((hit >= 0) & self.m.usable[hit], hit, -1)
                found[size] = hit
        last = np.full((m, n + 1), -2, np.int32)    # -2: no piece, -1: unknown character
        back = np.ones((m, n + 1), np.int32)
        if self.m.bpe:
            for end in range(1, n + 1):
                rest = np.arange(m)
                for size in range(min(end, self.longest), 0, -1):
                    if size not in found or not len(rest):
                        continue
                    t = found[size][rest, end - size]
                    has = t >= 0
                    who, t = rest[has], t[has]
                    if end > size:
                        before = last[who, end - size]
                        good = before == -1
                        paired = before >= 0
                        good[paired] = self._stay(before[paired], t[paired])
                        who, t = who[good], t[good]
                    last[who, end], back[who, end] = t, size
                    if len(who):
                        rest = rest[last[rest, end] == -2]
                # a character that is in no piece stands alone
                lone = rest[found[1][rest, end - 1] < 0] if 1 in found else rest
                last[lone, end] = -1
        else:
            best = np.full((m, n + 1), -np.inf)
            best[:, 0] = 0
            missing = float(self.m.score.min()) - 10.0
            for end in range(1, n + 1):
                top = best[:, end - 1] + missing
                last[:, end] = -1
                if 1 in found:
                    known = found[1][:, end - 1] >= 0
                    top = np.where(known, -np.inf, top)
                for size, hit in found.items():
                    if size <= end:
                        t = hit[:, end - size]
                        s = np.where(t >= 0, best[:, end - size] + self.m.score[t], -np.inf)
                        up = s > top
                        top = np.where(up, s, top)
                        last[up, end], back[up, end] = t[up], size
                best[:, end] = top
        return last, back

    def _plain(self, word: str) -> list[int]:
        """Runs of spaces have pieces of equal rank: their few words merge one by one."""
        out = []
        for p, _ in merge_words(word, self.rank_of):
            out += [self.id_of[p]] if p in self.id_of else self._unknown(p)
        return out

    def _unknown(self, c: str) -> list[int]:
        return self.m.byte_ids[list(c.encode())].tolist() if len(self.m.byte_ids) else [self.m.unknown]

    def _split(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Cuts words where no piece can reach across: the parts, and their number a word."""
        sizes = np.array([len(w) for w in words])
        stop = np.cumsum(sizes)
        text = "".join(words)
        points = _points(text).astype(np.int64)
        key = (points[:-1] << 32) | points[1:]
        joints = self.m.joints
        if len(joints):
            p = np.minimum(np.searchsorted(joints, key), len(joints) - 1)
            cut = np.flatnonzero(joints[p] != key) + 1
        else:
            cut = np.arange(1, len(points))
        cuts = np.union1d(cut, stop)
        parts = [text[i:j] for i, j in zip([0] + cuts[:-1].tolist(), cuts.tolist())]
        return parts, np.diff(np.concatenate([[0], np.searchsorted(cuts, stop, side="right")]))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each word; equal lengths advance together."""
        rows: list = []     # (word, place, id) by columns
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if self.m.bpe and SPACE * 2 in w:
                ids = self._plain(w) if len(w) <= 64 else self._long_run(w)
                rows.append((np.full(len(ids), k), np.arange(len(ids)) * 8, np.array(ids)))
            else:
                by_size.setdefault(len(w), []).append(k)
        for n, who in by_size.items():
            step = max(1, 400_000 // n)
            for i in range(0, len(who), step):
                part = np.array(who[i:i + step])
                points = _points("".join([words[k] for k in who[i:i + step]])).reshape(len(part), n)
                last, back = self._table(points)
                self._file_pairs()
                end, live = np.full(len(part), n), np.arange(len(part))
                while len(live):
                    e = end[live]
                    t = last[live, e]
                    rows.append((part[live], e * 8, t))
                    end[live] = e - back[live, e]
                    live = live[end[live] > 0]
        if not rows:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, place, ids = (np.concatenate([r[c] for r in rows]) for c in range(3))
        lone = np.flatnonzero(ids == -1)
        if len(lone):       # characters that are in no piece
            extra = []
            stray = set(zip(word[lone].tolist(), place[lone].tolist()))
            for k, e in sorted(stray):
                if len(self.m.byte_ids) or (k, e - 8) not in stray:
                    for c, x in enumerate(self._unknown(words[k][e // 8 - 1])):
                        extra.append((k, e + c, x))
            keep = ids != -1
            more = np.array(extra, dtype=np.int64).reshape(-1, 3)
            word, place, ids = (np.concatenate([v[keep], more[:, c]])
                                for c, v in enumerate((word, place, ids)))
        order = np.lexsort((place, word))
        return ids[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _long_run(self, word: str) -> list[int]:
        """A long run of spaces: it merges left to right, the word after it by the table."""
        lead = len(word) - len(word.lstrip(SPACE))
        out: list[int] = []
        if word[lead:]:     # the last space belongs to the word
            out = self.encode_words([SPACE + word[lead:]])[0].tolist()
            lead -= 1
        run: list[int] = []
        for s in sorted(self.m.keys, reverse=True):
            if SPACE * s in self.id_of:
                k, lead = divmod(lead, s)
                run += [self.id_of[SPACE * s]] * k
        return run + out

    def _remember(self, words: list[str]) -> None:
        if not words:
            return
        parts, count = self._split(words)
        distinct = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        ids, size = self.encode_words(list(distinct))
        at = np.cumsum(size) - size
        k = np.fromiter((distinct[p] for p in parts), np.int64, len(parts))
        flat = _gather(ids, at[k], size[k])
        owner = np.repeat(np.arange(len(words)), count)
        sizes = np.bincount(owner, weights=size[k], minlength=len(words)).astype(np.int64)
        base = self.at[-1]
        self.flat = np.concatenate([self.flat[:base], flat])
        self.memo.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words))))
        self.at = np.concatenate([self.at, base + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (whole texts, in pieces of bounded size)."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE_TEXT):
                size += len(texts[j])
                j += 1
            normal = [self.sp.normalize(t) if t else "" for t in texts[i:j]]
            words = [self.words.findall(t) if self.m.splittable else [t] * bool(t) for t in normal]
            if len(self.memo) > MEMO:
                self.memo, self.at = {}, np.zeros(1, np.int64)
            self._remember(sorted(set().union(*map(set, words)) - self.memo.keys()))
            at, memo = self.at, self.memo
            for ws in words:
                k = np.fromiter((memo[w] for w in ws), np.int64, len(ws))
                out.append(_gather(self.flat, at[k], at[k + 1] - at[k]))
            i = j
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces restored, the leading one of the encoder dropped."""
        raw = _gather(self.raw, self.raw_at[ids], self.raw_size[ids]).tobytes()
        return raw.decode("utf-8", "replace")[1:]

    def normal_text(self, text: str) -> str:
        """What a decoder should return: the normal form of ``text`` with plain spaces."""
        return self.sp.normalize(text).replace(SPACE, " ")[1:] if text else ""


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start:start + size] over many ranges."""
    total = int(size.sum())
    stop = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(start - (stop - size), size)]


def encode_documents(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Every row of ``docs`` (text kept aside) with ids, n_ids and round_trip.

    round_trip tells whether decoding the ids gives back the text's normal form.
    Defined results: null and empty texts have no ids; repeated rows are encoded
    alike; an empty table gives an empty result; other columns are kept, those
    called ids, n_ids or round_trip under their name with ``_given`` behind it.
    """
    made = ("ids", "n_ids", "round_trip")
    others = [(f, f.name + "_given" * (f.name in made)) for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part["__text"].to_pylist()
                ids = coder.encode(texts)
                back = [coder.decode(x) == coder.normal_text(t) for x, t in zip(ids, texts)]
                stop = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(stop), pa.array(
                    np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part[name] for _, name in others]
                    + [lists, pa.array([len(x) for x in ids], pa.int32()), pa.array(back, pa.bool_())],
                    [name for _, name in others] + list(made))

    schema = ", ".join([f"`{name}` {f.dataType.simpleString()}" for f, name in others]
                       + ["ids array<int>", "n_ids int", "round_trip boolean"])
    return docs.select(*[F.col(f"`{f.name}`").alias(name) for f, name in others],
                       text_or_empty().alias("__text")).mapInArrow(run, schema)


def op5_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, load_pieces())

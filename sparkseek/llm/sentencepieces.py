"""SentencePiece encoding and decoding by streaming Viterbi.

Characters come in one at a time; only a window of the last max-piece-length boundaries is live, each with one backpointer.
Whenever the paths of all live boundaries go through one boundary, the ids before it are committed and their pointers dropped,
so that memory is bounded by the window and by the ids not yet read.

Scores are the model's. In a unigram model a path's value is the sum of its pieces' scores and the best path to each boundary
survives. In a BPE model a path is a segmentation that merging would leave as it is: each piece encodes to itself, and so do each
two neighbours as a pair. Exactly one such path leads to each boundary (merges are ordered by the merged piece alone, leftmost
first), so that survival is a matter of validity and the surviving path to the last boundary is what merging gives.

Texts are taken in stretches of bounded length. Spaces are escaped first. Where no piece holds an escaped space after another character, all paths converge before each run of
them; what lies between two such boundaries is a chunk whose ids depend on it alone, so encoded chunks are remembered, up to
MEMO of them in each worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import spread
from .common import remembered, tidy

SPACE = "▁"
#: Remembered chunks, and pairs of pieces, in a worker; beyond this they are forgotten and found anew.
MEMO, PAIRS = 300_000, 200_000


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """Vocabulary, scores and rules of a model file, without normalisation beyond the escaping of spaces."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        spec.ParseFromString(proto)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a character map that keep all white space are read")
        self.bpe = spec.trainer_spec.model_type == 2
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.unknown = self.kinds.index(2)
        by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.byte_of = {i: b for b, i in by_byte.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Characters that stand in pieces but are none themselves.
        self.inner = {c for p in self.ids if len(p) > 1 for c in p if c not in self.ids}
        self.packed = [np.int32(i).tobytes() for i in range(len(spec.pieces))]
        #: What each id adds to a text; bytes over 127 as lone surrogates until they are joined.
        self.shown = ["" if k == 3 else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds)]
        for i, b in self.byte_of.items():
            self.shown[i] = bytes([b]).decode("utf-8", "surrogateescape")
        #: By piece id, which piece ids may stand after it; n_follow counts what is known.
        self.follow: dict[int, dict[int, bool]] = {}
        self.n_follow = 0
        self.memo: dict[str, bytes] = {}
        if self.bpe:
            self._split()

    def _split(self) -> None:
        """How merging makes each piece: the two pieces of its last merge. A piece that merging never makes takes no part."""
        self.halves: dict[str, tuple[str, str]] = {}
        score = self.score
        for p in [p for p in self.ids if len(p) > 1]:
            parts = self.merged(p, 2)
            if len(parts) == 2:
                self.halves[p] = (parts[0], parts[1])
            else:
                del self.ids[p]
        #: Pieces made by merges whose scores fall from each to the next; others, such as long runs of spaces, are merged in full.
        self.orderly: set[str] = {p for p in self.ids if len(p) == 1}
        for p in sorted(self.halves, key=len):
            if all(x in self.orderly and (len(x) == 1 or score[x] > score[p]) for x in self.halves[p]):
                self.orderly.add(p)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Merging as defined: the best-scored neighbours that make a piece, leftmost first, until there are none, or `least` parts."""
        get, none = self.score.get, float("-inf")
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def lasting(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces side by side.

        Where scores fall with each merge, merges come in the order of their scores. Two pieces then, the one at the right edge of
        what is left so far, the other at the left edge of what is right, join if they make a piece that comes before the next merge
        of either; the left one comes first if both make the same. Otherwise merging is done.
        """
        if left not in self.orderly or right not in self.orderly:
            return left + right not in self.score and self.merged(left + right) == [left, right]
        score, halves, least = self.score, self.halves, float("-inf")
        x, y, next_x, next_y = left, right, least, least  # the pieces at the edge, and the scores of the merges that make more of them
        while True:
            joined = score.get(x + y)
            if joined is not None and joined > next_x and joined >= next_y:
                return False
            # go back in time: undo the later of the merges that made x and y, that at the right if both are alike
            at_x = score[x] if len(x) > 1 else None
            at_y = score[y] if len(y) > 1 else None
            if at_x is None and at_y is None:
                return True
            if at_y is None or at_x is not None and at_x < at_y:
                x, next_x = halves[x][1], at_x
            else:
                y, next_y = halves[y][0], at_y

    def to_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def escape(self, text: str) -> str:
        if not text:
            return ""
        return ((SPACE if self.prefix else "") + text).replace(" ", SPACE)


class Streaming:
    """One text on its way: feed() characters, read committed ids, then finish()."""

    def __init__(self, model: Model):
        self.m, self.tail, self.at = model, "", 0
        self.live: dict[int, tuple[int, str, float]] = {0: (-1, "", 0.0)}  # boundary: where its last piece begins, the piece, value
        self.start, self.due = 0, 2 * model.longest

    def _best(self, end: int) -> tuple[int, str, float]:
        """The surviving last piece of a path to a boundary."""
        m, tail, live = self.m, self.tail, self.live
        best, n = None, len(tail)
        for size in range(1, min(m.longest, n) + 1):
            if end - size not in live:
                continue
            piece = tail[n - size :]
            if piece not in m.ids and size > 1:
                continue
            _, last, value = live[end - size]
            if m.bpe:
                if not last or m.lasting(last, piece):
                    return end - size, piece, 0.0
            else:
                value += m.score.get(piece, m.least)
                if best is None or value > best[2]:
                    best = (end - size, piece, value)
        if best is None:
            raise AssertionError("no path")
        return best

    def _path(self, end: int) -> list[int]:
        out = [end]
        while end > self.start:
            end = self.live[end][0]
            out.append(end)
        return out

    def _take(self, upto: int) -> list[int]:
        """Ids from the last committed boundary to this one; what lies before it is dropped."""
        pieces, b = [], upto
        while b > self.start:
            b, piece, _ = self.live[b]
            pieces.append(piece)
        self.start = upto
        for b in [b for b in self.live if b < upto]:
            del self.live[b]
        base = self.live[upto][2]
        if base:  # values count from here
            self.live = {b: (s, p, v - base) for b, (s, p, v) in self.live.items()}
        return [i for p in reversed(pieces) for i in self.m.to_ids(p)]

    def feed(self, chars: str) -> Iterator[list[int]]:
        longest = self.m.longest
        for c in chars:
            self.tail = (self.tail + c)[-longest:]
            self.at += 1
            self.live[self.at] = self._best(self.at)
            if len(self.live) >= self.due:  # look for a boundary on all paths
                common = set(self._path(self.at))
                for b in range(max(self.start, self.at - longest + 1), self.at):
                    if b in self.live:
                        common &= set(self._path(b)) | ({b} if b == self.start else set())
                meet = max(common)
                if meet > self.start:
                    yield self._take(meet)
                    self._drop()
                self.due = len(self.live) + longest

    def _drop(self) -> None:
        """Forget boundaries that no live path uses."""
        used = set()
        for b in range(max(self.start, self.at - self.m.longest + 1), self.at + 1):
            if b in self.live:
                used.update(self._path(b))
        self.live = {b: x for b, x in self.live.items() if b in used}

    def finish(self) -> list[int]:
        return self._take(self.at)


def encode_stream(model: Model, escaped: Iterable[str]) -> Iterator[list[int]]:
    """Committed ids of an escaped text that comes in strings of any length."""
    s = Streaming(model)
    for part in escaped:
        yield from s.feed(part)
    yield s.finish()


_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


#: Boundaries that are held of a chunk before a place is looked for where all paths meet.
WINDOW = 64


def _sorted_ids(m: Model, chunks: Iterable[str]) -> Iterator[tuple[str, bytes]]:
    """Ids of chunks, as bytes of 32-bit numbers. Of a BPE model's chunk a window of boundaries is held, each with its one surviving path; when the window is full,
    ids are committed up to where the paths of all boundaries that a next piece may begin at meet, and the window moves there. What is found of a prefix
    holds for every chunk that begins so, and in sorted order the next chunk goes on from what it shares with the one before."""
    ids, longest, lasting, pieces, follow, packed = m.ids, m.longest, m.lasting, m.pieces, m.follow, m.packed
    size = max(WINDOW, 2 * longest)
    known, last, begin, allowed = "", [-1] * (size + 1), [0] * (size + 1), [{} for _ in range(size + 1)]

    def taken(part: str, upto: int) -> bytes:
        out: list[bytes] = []
        while upto:
            out.append(packed[last[upto]] if last[upto] >= 0 else b"".join([packed[i] for i in m.to_ids(part[begin[upto] : upto])]))
            upto = begin[upto]
        return b"".join(out[::-1])

    def meeting(upto: int) -> int:
        """The last boundary on the paths to all of those that a piece after `upto` may begin at."""
        live = set(range(max(0, upto - longest + 1), upto + 1))
        while len(live) > 1:  # go back from the last of them
            high = max(live)
            live.remove(high)
            live.add(begin[high])
        return live.pop()

    for chunk in sorted(chunks):
        n = len(chunk)
        if chunk in ids:
            yield chunk, packed[ids[chunk]]
            continue
        if not m.bpe or not m.inner.isdisjoint(chunk):
            yield chunk, b"".join([packed[i] for part in encode_stream(m, [chunk]) for i in part])
            continue
        shared = 0
        for c, d in zip(known, chunk):
            if c != d:
                break
            shared += 1
        known, part, after, done = chunk[:size], chunk[:size], size, []
        while True:
            for end in range(shared + 1, len(part) + 1):
                for at in range(end - 1, max(-1, end - 1 - longest), -1):  # one path at most is valid, and its last piece is short as a rule
                    piece = ids.get(part[at:end])
                    if piece is None:
                        if at < end - 1:
                            continue
                        piece = -1  # a character that no piece has: any path may end here, and the next piece begins anew
                        break
                    before = last[at]
                    if before < 0:
                        if at == 0 or begin[at] == at - 1:
                            break
                        continue
                    ok = allowed[at].get(piece)
                    if ok is None:
                        if m.n_follow >= PAIRS:
                            follow.clear()
                            m.n_follow = 0
                            allowed[:end] = [follow.setdefault(p, {}) if p >= 0 else {} for p in last[:end]]
                        m.n_follow += 1
                        ok = allowed[at][piece] = lasting(pieces[before], pieces[piece])
                    if ok:
                        break
                last[end], begin[end] = piece, at
                allowed[end] = follow.setdefault(piece, {}) if piece >= 0 else {}
            if after >= n:
                done.append(taken(part, len(part)))
                break
            at = meeting(len(part))
            if at:  # commit, and move the window
                done.append(taken(part, at))
                known, shared = "", len(part) - at
                last[: shared + 1], allowed[: shared + 1] = last[at : len(part) + 1], allowed[at : len(part) + 1]
                begin[: shared + 1] = [max(0, b - at) for b in begin[at : len(part) + 1]]
            else:  # the paths have not met yet: hold more
                shared = len(part)
                last += [-1] * size
                begin += [0] * size
                allowed += [{} for _ in range(size)]
            part = part[at:] + chunk[after : after + len(last) - 1 - shared]
            after += len(part) - shared
        yield chunk, b"".join(done)
        if not known:
            last[0], begin[0], allowed[0] = -1, 0, {}


#: Characters of texts whose chunks are held at once, about.
STRETCH = 1 << 21


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters, cut at single spaces, where all paths meet; each part then begins like a text."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.find(" ", at + STRETCH)
        while cut > 0 and (text[cut - 1] in (" ", SPACE) or text[cut + 1 : cut + 2] in ("", " ", SPACE)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode_all(model: Model, texts: list[str]) -> list[np.ndarray]:
    """Ids of texts, as the library gives them without begin and end ids; chunks of a bounded number of characters are held at once."""
    if not model.chunked or not model.prefix:
        return [np.fromiter((i for ids in encode_stream(model, [model.escape(t)]) for i in ids), np.int32) for t in texts]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    some: list[tuple[int, str]] = []
    held = 0

    def flush() -> None:
        for (i, _), ids in zip(some, _encode_held(model, [t for _, t in some])):
            out[i].append(ids)
        some.clear()

    for i, text in enumerate(texts):
        for t in stretches(text):
            some.append((i, t))
            held += len(t)
            if held >= STRETCH:
                flush()
                held = 0
    flush()
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


def _encode_held(model: Model, texts: list[str]) -> list[np.ndarray]:
    memo, parts = model.memo, []
    for t in texts:
        if SPACE in t or "  " in t or t[:1] in ("", " ") or t[-1] == " ":
            parts.append([c[1:] if c[0] == SPACE and c[1:2] not in ("", SPACE) else SPACE + c for c in _CHUNK.findall(model.escape(t))])
        else:  # each word follows one space, which the keys of remembered chunks leave out
            parts.append(t.split(" "))
    new = set().union(*parts)
    if len(memo) + len(new) > MEMO:
        memo.clear()
    new.difference_update(memo)
    chunk_of = {k[1:] if k[:1] == SPACE else SPACE + k: k for k in new}
    for chunk, ids in _sorted_ids(model, chunk_of):
        memo[chunk_of[chunk]] = ids
    return [np.frombuffer(b"".join(map(memo.__getitem__, keys)), np.int32) for keys in parts]


def encode(model: Model, text: str) -> np.ndarray:
    return encode_all(model, [text])[0]


def decode(model: Model, ids: np.ndarray | list[int]) -> str:
    """The text of ids: byte pieces joined to UTF-8, spaces unescaped, the leading dummy space taken off."""
    ids = np.asarray(ids, np.int32)
    text = "".join(["".join(map(model.shown.__getitem__, ids[at : at + STRETCH].tolist())) for at in range(0, len(ids), STRETCH)])
    if not text.isascii() and model.bytes and any("\udc80" <= c <= "\udcff" for c in set(text)):
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text[1:] if model.prefix and text[:1] == " " else text


def worker_model(path: str) -> Model:
    """One model for each Python worker, until it ends a task of another operator."""
    if path not in remembered:
        remembered[path] = Model(path)
    return remembered[path]


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", keep_text: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, ids array<int>, n_tokens, n_bytes, ids_crc32, round_trip[, text]).

    ids are those of the whole text without begin, end or added special ids; strings of special pieces in a text are ordinary text.
    round_trip: decoding gives the text again (it can't where the text holds the escape character itself). Null, like empty,
    text has no ids, and comes back as null in text. Rows with equal or null doc_id are encoded each for itself. Empty tables
    give no rows. Each row is encoded where it is read: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_model(tokenizer_path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                ids = encode_all(m, [t or "" for t in texts])
                flat = np.concatenate(ids)
                ends = np.cumsum([0, *map(len, ids)])
                back = [decode(m, x) for x in ids]
                columns = [
                    part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(np.diff(ends), pa.int64()),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64()),
                    pa.array([b == (t or "") for b, t in zip(back, texts)]),
                ]
                names = ["doc_id", "ids", "n_tokens", "n_bytes", "ids_crc32", "round_trip"]
                if keep_text:
                    columns.append(pa.array([None if t is None else b for b, t in zip(back, texts)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)
        m.memo.clear()
        tidy(keep=True)

    schema = "doc_id long, ids array<int>, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean" + ", text string" * keep_text
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)

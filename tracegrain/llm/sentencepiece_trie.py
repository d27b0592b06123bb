"""SentencePiece encoding by a forward pass that shares prefixes, and decoding.

A text is marked as the vocabulary's library does (a leading mark, spaces as
marks) and cut into marked words; no piece holds a mark after another character,
so no piece crosses a cut. The distinct words of a slice are sorted, which is the
depth-first order of their trie: going from one word to the next, the forward
states of the common prefix stay and only the rest is computed.

The forward pass is Viterbi's: each position holds the best score of any sequence
of pieces that ends there, with the last piece and where it begins; the argmax is
kept, and the path is read back from the end. What a piece adds depends on the
kind of vocabulary:

* ``unigram``: the piece's score;
* ``bpe``, whose "scores" are merge ranks and whose segmentation is not that of
  their largest sum: 0 after a piece that it may follow, minus infinity after any
  other. It may follow if merging the two alone gives just these two again.
  Merges go by rank, then from the left, so a sequence is the merges' result
  exactly if its score is 0, the largest that there is; a position is settled by
  the first candidate that reaches it. Results equal the library's, id for id.

Characters without a piece become bytes if the vocabulary has them (else the
unknown id). Decoding joins the pieces' bytes and takes the leading mark off.

Defined results: null and empty texts have no ids and decode to the empty text;
any U+2581 of a text is a mark, hence a space after decoding; repeated rows give
repeated results; an empty table gives an empty table; texts are encoded whole,
however long, in slices of bounded size.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .worker_memory import release

MARK = "▁"
_NEVER = float("-inf")
#: Words that a worker remembers in a generation, pairs of pieces that it remembers, and characters that it takes at once.
_CACHE, _PAIRS, _SLICE = 220_000, 800_000, 1 << 20
#: Codecs of this worker process, kept from one task to the next.
_HELD: dict[tuple[str, str], Codec] = {}


def vocabulary_path(file: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file on this machine."""
    return importlib.import_module("public_tokenizers").path(file)


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model file."""

    pieces: list[str]
    scores: list[float]
    special: set[int]  # control, unknown and unused pieces: never made from a text
    byte_ids: list[int] | None
    unknown: int
    kind: str
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        bytes_ = set(self.byte_ids or ())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in bytes_}

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        byte_ids = [i for i in n if sp.is_byte(i)]
        return cls(
            [sp.id_to_piece(i) for i in n],
            [sp.get_score(i) for i in n],
            {i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)},
            byte_ids if len(byte_ids) == 256 else None,
            sp.unk_id(),
            kind,
        )


def merge(word: str, vocabulary: Vocabulary) -> list[str]:
    """Merges by rank, then from the left: the definition that the lattice must equal."""
    parts, ids, scores = list(word), vocabulary.ids, vocabulary.scores
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            piece = ids.get(parts[i] + parts[i + 1])
            if piece is not None and (best is None or scores[piece] > best):
                best, at = scores[piece], i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class TrieEncoder:
    """Ids of marked words; words of a call share the forward states of their prefixes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.steps = 0  # positions computed; tests compare it with the words' lengths
        # Pieces that merges reach from their own characters, by number; characters without a piece are added later.
        self.known = {p: i for p, i in vocabulary.ids.items() if vocabulary.kind != "bpe" or merge(p, vocabulary) == [p]}
        self.names = dict(enumerate(vocabulary.pieces))
        self.outputs = {i: [i] for i in range(len(vocabulary.pieces))}
        self.pairs: dict[int, float] = {}
        self.longest = max(map(len, self.known), default=1)
        # Lengths of the pieces that end in three given characters, longest first: no others need a test.
        ends: dict[str, set[int]] = {}
        for p in self.known:
            if len(p) > 2:
                ends.setdefault(p[-3:], {1, 2}).add(len(p))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in ends.items()}

    def _number(self, character: str) -> int:
        """Number of a character that has no piece; its output is its bytes or the unknown id."""
        number = self.known[character] = len(self.names)
        self.names[number] = character
        byte_ids = self.vocabulary.byte_ids
        raw = character.encode("utf-8", "surrogatepass")
        self.outputs[number] = [byte_ids[b] for b in raw] if byte_ids else [self.vocabulary.unknown]
        return number

    def _follows(self, code: int) -> float:
        """What the piece of number ``code & 0xFFFFFF`` adds after the piece ``code >> 24``: 0, or minus infinity."""
        pair = [self.names[code >> 24], self.names[code & 0xFFFFFF]]
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        known = self.pairs[code] = 0.0 if merge("".join(pair), self.vocabulary) == pair else _NEVER
        return known

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Depth-first over the trie of the sorted distinct words: each with the numbers of its pieces."""
        extend = self._extend_unigram if self.vocabulary.kind == "unigram" else self._extend_bpe
        # At each position of the current path: the last piece, where it begins, and the best score.
        pieces, starts, sums = [-1], [0], [0.0]
        before = ""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del pieces[shared + 1 :], starts[shared + 1 :], sums[shared + 1 :]
            self.steps += len(word) - shared
            extend(word, pieces, starts, sums)
            before = word
            path, at = [], len(word)
            while at:
                path.append(pieces[at])
                at = starts[at]
            path.reverse()
            yield word, path

    def _extend_bpe(self, word: str, pieces: list[int], starts: list[int], sums: list[float]) -> None:
        get, pair, tails = self.known.get, self.pairs.get, self.tails.get
        for end in range(len(pieces), len(word) + 1):
            best, last, begin = _NEVER, -1, -1
            for length in tails(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - length
                if start < 0:
                    continue
                piece = get(word[start:end])
                if piece is None:
                    if length > 1:
                        continue
                    piece = self._number(word[start:end])
                score = sums[start]
                if start:
                    code = pieces[start] << 24 | piece
                    adds = pair(code)
                    score += self._follows(code) if adds is None else adds
                if score > best:
                    best, last, begin = score, piece, start
                    if score == 0.0:  # no score is larger
                        break
            if last < 0:  # cannot be, since the merges always have a result
                raise AssertionError(f"no segmentation of {word[:end]!r}")
            pieces.append(last)
            starts.append(begin)
            sums.append(best)

    def _extend_unigram(self, word: str, pieces: list[int], starts: list[int], sums: list[float]) -> None:
        scores, lost = self.vocabulary.scores, min(self.vocabulary.scores) - 10.0
        for end in range(len(pieces), len(word) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):
                piece = self.known.get(word[start:end])
                if piece is None and end - start == 1:
                    piece = self._number(word[start:end])
                if piece is not None:
                    total = sums[start] + (scores[piece] if piece < len(scores) else lost)
                    if best is None or total > best[0]:
                        best = (total, piece, start)
            sums.append(best[0])
            pieces.append(best[1])
            starts.append(best[2])

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        plain, outputs = len(self.vocabulary.pieces), self.outputs
        return {
            word: path if max(path, default=0) < plain else [i for p in path for i in outputs[p]]
            for word, path in self.segment(words)
        }


def text_words(text: str) -> list[str]:
    """The words of a text without their mark; further marks before a word stand as spaces."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    words, held = [], 0
    for part in text.split(" "):
        if part:
            words.append(" " * held + part)
            held = 0
        else:
            held += 1
    if held:
        words.append(" " * (held - 1))
    return words


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` laid end to end, and their lengths."""
    n = lengths[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], n


class _Memory:
    """Words with their ids, in arrays."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.number), len(words)
        self.number.update(zip(words, range(first, first + n)))
        while first + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)


class Codec:
    """Encodes and decodes lists of texts, remembering words between calls.

    Words are kept in two generations of ``_CACHE`` words: a full one becomes
    the old one, and what is met again moves to the new one.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.encoder = TrieEncoder(vocabulary)
        raw = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids or ()):
            raw[i] = bytes([b])
        for i in vocabulary.special:
            raw[i] = b""
        self.raw = raw
        self.young, self.old = _Memory(), _Memory()

    def _learn(self, new: set[str]) -> None:
        old = self.old.number
        known = [w for w in new if w in old]
        if known:
            self.young.add(known, *_gather(self.old.flat, self.old.starts, self.old.lengths, np.array([old[w] for w in known])))
            new = new.difference(known)
        marked = self.encoder.encode([MARK + w.replace(" ", MARK) for w in new])
        lengths = np.fromiter(map(len, marked.values()), dtype=np.int64, count=len(marked))
        flat = np.fromiter(chain.from_iterable(marked.values()), dtype=np.int32, count=int(lengths.sum()))
        self.young.add([w[1:].replace(MARK, " ") for w in marked], flat, lengths)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and the number of ids of each."""
        words = [text_words(t or "") for t in texts]
        if len(self.young.number) > _CACHE:
            self.young, self.old = _Memory(), self.young
        young = self.young
        every = list(chain.from_iterable(words))
        if new := set(every).difference(young.number):
            self._learn(new)
        counts = np.array([len(w) for w in words], dtype=np.int64)
        which = np.array(list(map(young.number.__getitem__, every)), dtype=np.int64)
        flat, n = _gather(young.flat, young.starts, young.lengths, which)
        sums = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])

    def forget(self) -> None:
        """Drop the remembered words; pieces and their pairs stay."""
        self.young, self.old = _Memory(), _Memory()

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence of ids."""
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def held_codec(path: str, kind: str) -> Codec:
    """This process's codec of a vocabulary file."""
    if (path, kind) not in _HELD:
        _HELD[path, kind] = Codec(Vocabulary.load(path, kind))
    return _HELD[path, kind]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, kind: str = "bpe") -> DataFrame:
    """``doc_id``, ``token_ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(vocabulary or vocabulary_path(), kind)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                part = texts[a:b]
                flat, counts = codec.encode(part)
                ends = np.cumsum(counts)
                same = [codec.decode(flat[e - n : e]) == (t or "").replace(MARK, " ") for t, n, e in zip(part, counts, ends)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())],
                    names=[doc_id, "token_ids", "n_tokens", "round_trip"],
                )
        codec.forget()
        release()

    key = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {key}, token_ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(vocabulary or vocabulary_path(), "bpe")
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return encoded.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {dict(encoded.dtypes)[doc_id]}, text string")

"""SentencePiece encoding and decoding with forward scores shared by prefixes.

The texts of a batch are split into marked words (a run of ``▁`` and what
follows), and the distinct ones are sorted. Sorted words are the leaves of a
trie in depth-first order: the forward state of a word is kept as a stack, and
the next word reuses it up to their common prefix.

The available public model is a BPE model whose piece scores are merge ranks, so
the path of greatest summed score isn't what the reference tokenizer returns.
The forward step therefore takes, of the pieces that end at a position, the one
that agrees with the best path of the text before it: the pair (last piece
there, piece) must itself encode to that pair. This is exact for BPE and, like a
Viterbi step, depends on the prefix alone. A unigram model takes the step of
greatest summed score.

Edge cases: null and empty texts have no ids. Characters outside the vocabulary
become byte pieces, or ``<unk>`` where the model has none. Very long words cost
their length times the longest piece. Repeated rows are encoded each on its own.
An empty table gives no rows. Equal merges take the leftmost, equal sums the longer
last piece. Extra columns pass through; ``ids``, ``n_tokens`` and ``lossless``, when
decoding ``decoded``, are replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bound_batches, keeps
from .wordhash import text_chunks

#: Path of the model that is used unless another is given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of text whose words are sorted together; neighbours share more of their state in a larger set.
STEP_BYTES = 3_000_000
#: More than there are pieces and code points.
SYMBOLS = 1 << 32
#: Most words whose ids a worker keeps between batches.
CACHE_WORDS = 200_000
#: Most pairs of symbols whose agreement a worker keeps; to find it anew is dear.
CACHE_PAIRS = 400_000


@dataclass
class Vocabulary:
    """What the forward step needs of a model; bounded by the model's size, so it can be sent to every task."""

    pieces: dict[str, int]
    scores: list[float]
    text: list[str]
    byte_ids: list[int]
    unknown: int
    bpe: bool = True
    dummy_prefix: bool = True
    longest: int = 1
    digest: str = ""
    #: Lengths of the pieces that end with some two to four letters, longest first.
    lengths: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)
    #: Ids of the bytes that aren't characters by themselves.
    high_bytes: dict[int, bytes] = field(default_factory=dict, repr=False)
    least: float = 0.0
    _pairs: dict[int, bool] = field(default_factory=dict, repr=False)
    _lossy: set[str] = field(default_factory=set, repr=False)
    _young: dict[str, bytes] = field(default_factory=dict, repr=False)
    _old: dict[str, bytes] = field(default_factory=dict, repr=False)

    def symbol(self, k: int) -> str:
        return self.text[k] if k < len(self.text) else chr(k - len(self.text))

    def __getstate__(self):
        return {k: (type(v)() if k in ("_pairs", "_young", "_old", "_lossy") else v) for k, v in self.__dict__.items()}


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a model on the driver. The normaliser must be the identity, apart from marks for spaces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  b éﬁ "
    plain = MARK + probe.replace(" ", MARK)
    if sp.normalize(probe) not in (plain, plain[1:]):
        raise ValueError("models with a normaliser aren't supported")
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): i for i in normal}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece crosses words")
    text = [""] * n
    for p, i in pieces.items():
        text[i] = p
    byte_ids = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
    for b in range(128):
        if byte_ids[b] >= 0:
            text[byte_ids[b]] = chr(b)
    scores = [sp.get_score(i) for i in range(n)]
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    v = Vocabulary(
        pieces,
        scores,
        text,
        byte_ids if min(byte_ids) >= 0 else [],
        sp.unk_id(),
        # A BPE model's scores are the negated ranks of its merges, those of a unigram model aren't whole.
        bpe=all(x == int(x) for x in scores),
        dummy_prefix=sp.normalize(probe) == plain,
        longest=max(map(len, pieces)),
        digest=digest,
        high_bytes={byte_ids[b]: bytes([b]) for b in range(128, 256) if byte_ids[b] >= 0},
        least=min(scores) - 10,
    )
    if v.bpe:
        # A piece that its own letters don't merge to is never the answer.
        ends: dict[str, set[int]] = {}
        for p in [p for p in pieces if len(p) > 1]:
            if merged(v, p) != [p]:
                del pieces[p]
                continue
            for k in (2, 3, 4):
                if len(p) >= k:
                    ends.setdefault(p[-k:], set()).add(len(p))
        fit = {e: k | {j for j in range(2, len(e)) if e[-j:] in pieces} for e, k in ends.items()}
        v.lengths = {e: tuple(sorted(k, reverse=True)) for e, k in fit.items()}
    return v


def merged(v: Vocabulary, word: str) -> list[str]:
    """BPE of a short string by its definition: merge the best-scored adjacent pair, leftmost first."""
    parts = list(word)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = v.pieces.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or v.scores[k] > best):
                best, at = v.scores[k], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _agrees(v: Vocabulary, a: int, b: int) -> bool:
    """Whether symbols a and b, side by side, encode to themselves."""
    if len(v._pairs) > CACHE_PAIRS:
        v._pairs.clear()
    left, right = v.symbol(a), v.symbol(b)
    got = v._pairs[a * SYMBOLS + b] = merged(v, left + right) == [left, right]
    return got


def encode_sorted(v: Vocabulary, words: list[str]) -> Iterator[tuple[bytes, bool]]:
    """Ids (32 bits each) of each of the sorted distinct words, and whether they decode to it.

    The forward state up to a common prefix is reused.

    The state of a prefix is the symbol that ends its best path, and its length.
    A letter outside the vocabulary is the symbol of its code point after the pieces.
    """
    state, size, total = [0], [0], [0.0]
    before = ""
    shorter = ((), (), (2,), (3, 2))
    pieces, lengths, pairs, none, n_pieces, letters = v.pieces, v.lengths, v._pairs, (), len(v.text), v.text
    odd: list[int] = []  # ends of the letters outside the vocabulary
    for word in words:
        # Neighbours in order differ near their ends.
        i = min(len(before), len(word))
        if i > 64:
            i = bisect_left(range(i), True, key=lambda k: before[: k + 1] != word[: k + 1])
        while before[:i] != word[:i]:
            i -= 1
        del state[i + 1 :], size[i + 1 :]
        while odd and odd[-1] > i:
            odd.pop()
        if not v.bpe:
            del total[i + 1 :]
        for end in range(i + 1, len(word) + 1):
            chosen, width = -1, 1
            if v.bpe:
                # Lengths of the pieces that end with these four letters, or else three or two, longest first.
                if end > 3:
                    fit = lengths.get(word[end - 4 : end]) or lengths.get(word[end - 3 : end]) or lengths.get(word[end - 2 : end], none)
                else:
                    fit = shorter[end]
                for k in fit:
                    if k > end:
                        continue
                    piece = pieces.get(word[end - k : end])
                    if piece is None:
                        continue
                    if k < end:
                        last = state[end - k]
                        agrees = pairs.get(last * SYMBOLS + piece)
                        if agrees is None:
                            agrees = _agrees(v, last, piece)
                        if not agrees:
                            continue
                    chosen, width = piece, k
                    break
            else:
                best = None
                for begin in range(max(0, end - v.longest), end):
                    k = pieces.get(word[begin:end])
                    if k is None and begin < end - 1:
                        continue
                    score = total[begin] + (v.scores[k] if k is not None else v.least)
                    if best is None or score > best:
                        chosen, width, best = -1 if k is None else k, end - begin, score
                total.append(best)
            if chosen < 0:
                letter = word[end - 1]
                chosen = pieces.get(letter, -1)
                if chosen < 0:
                    chosen = n_pieces + ord(letter)
                    odd.append(end)
            state.append(chosen)
            size.append(width)
        before = word
        ids, at = [], len(word)
        while at > 0:
            ids.append(state[at])
            at -= size[at]
        ids.reverse()
        if odd:
            plain = []
            for k in ids:
                if k < n_pieces:
                    plain.append(k)
                elif v.byte_ids:
                    plain.extend([v.byte_ids[b] for b in chr(k - n_pieces).encode()])
                else:
                    plain.append(v.unknown)
            ids = plain
            whole = _letters(v, ids) == word
        else:
            whole = "".join([letters[k] for k in ids]) == word
        yield array("i", ids).tobytes(), whole


def marked(v: Vocabulary, text: str) -> str:
    return ((" " if v.dummy_prefix else "") + text).replace(" ", MARK) if text else ""


def encode_texts(v: Vocabulary, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
    """Ids of each text, and whether they decode to the text (a mark in a text stands for a space)."""
    split = [_words(v, t or "") for t in texts]
    # Two generations of words: those in use move to the younger, the elder goes when it is full.
    if len(v._young) > CACHE_WORDS:
        v._old, v._young = v._young, {}
        v._lossy.intersection_update(v._old)
    young, old = v._young, v._old
    distinct = set().union(*split).difference(young)
    if old:
        again = [w for w in distinct if w in old]
        young.update([(w, old[w]) for w in again])
        distinct.difference_update(again)
    head = MARK if v.dummy_prefix else ""
    new = sorted(distinct)
    # Words are decoded once each, too: a text comes back whole if its words do.
    for w, (ids, whole) in zip(new, encode_sorted(v, [head + w for w in new])):
        young[w] = ids
        if not whole:
            v._lossy.add(w)
    lossless = [v._lossy.isdisjoint(ws) for ws in split] if v._lossy else [True] * len(split)
    return [np.frombuffer(b"".join([young[w] for w in ws]), np.int32) for ws in split], lossless


def _words(v: Vocabulary, text: str) -> list[str]:
    """The marked words of a text, without their first mark where all have one."""
    if not v.dummy_prefix:
        return _WORD.findall(marked(v, text))
    if not text or "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ") if text else []
    return [w[1:] for w in _WORD.findall(marked(v, text))]


def _letters(v: Vocabulary, ids: Sequence[int]) -> str:
    """Pieces and joined byte pieces of the ids, with marks."""
    if v.high_bytes.keys().isdisjoint(ids):
        return "".join(map(v.text.__getitem__, ids))
    return b"".join([v.high_bytes.get(k) or v.text[k].encode() for k in ids]).decode(errors="replace")


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """Text of the ids: byte pieces are joined to UTF-8, marks become spaces, the dummy prefix goes."""
    text = _letters(v, ids).replace(MARK, " ")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


_resident: dict[str, Vocabulary] = {}
keeps(_resident.clear)


def resident(v: Vocabulary) -> Vocabulary:
    """The copy of a vocabulary that stays in this process, with the words it has seen in earlier tasks."""
    return _resident.setdefault(v.digest, v)


def _encode(batches: Iterator[pa.RecordBatch], v: Vocabulary, column: str, step: int) -> Iterator[pa.RecordBatch]:
    v = resident(v)
    for batch in batches:
        for first, stop, _, _ in text_chunks(batch.column(column), step):
            part = batch.slice(first, stop - first)
            texts = part.column(column).to_pylist()
            ids, _ = encode_texts(v, texts)
            lossless = [decode_ids(v, k.tolist()) == (t or "") for k, t in zip(ids, texts)]
            lengths = np.array([len(k) for k in ids], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(lengths), pa.array(lossless)], names=[*part.schema.names, "ids", "n_tokens", "lossless"])


def encode(df: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", step: int = STEP_BYTES) -> DataFrame:
    """Add ids, n_tokens and lossless (whether decoding the ids gives the text)."""
    v = load_vocabulary(model)
    df = df.drop(*[c for c in ("ids", "n_tokens", "lossless") if c in df.columns])
    schema = T.StructType(
        [*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    )
    return bound_batches(df).mapInArrow(lambda it: _encode(it, v, text, step), schema)


def _decode(batches: Iterator[pa.RecordBatch], v: Vocabulary, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [decode_ids(v, k or []) for k in batch.column(column).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(df: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """Add decoded, the text of an id list; null counts as empty."""
    v = load_vocabulary(model)
    df = df.drop(*[c for c in ("decoded",) if c in df.columns])
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    return bound_batches(df).mapInArrow(lambda it: _decode(it, v, ids), schema)

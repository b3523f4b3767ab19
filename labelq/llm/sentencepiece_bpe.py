"""SentencePiece BPE encoding and decoding by backtracking over longest matches.

A merge-type (BPE) SentencePiece model repeatedly merges the adjacent pair whose joined string is the
best-scoring piece, leftmost first.  Instead of replaying merges over the text, ``Codec`` walks
it from left to right: Aho-Corasick matching gives the longest piece at every position, a piece may follow
another only if re-merging the two joined strings gives exactly that pair back, a shorter piece is
tried when it does not, and a bitfield marks positions from which no valid continuation
exists, so no dead end is entered twice.  Pair checks are remembered.

A text is cut before every run of the space mark that follows another character when no
piece of the model holds such a boundary (checked when the model is loaded; otherwise the
text is encoded in one piece).  Merges cannot cross these cuts, so parts are encoded on their own and
remembered, which makes repeated words cheap.  A new part is cut once more between letters or digits and other
characters, where no piece holds the two characters side by side, so a word is encoded once whatever marks follow it.  Characters that no piece covers become byte pieces.

Defined results: null counts as empty, which encodes to the end id alone and decodes to ''; repeated rows
are encoded one by one; very long texts and very long words are processed whole (memory grows with one
text only); a null doc_id stays null; empty tables give empty results; extra columns are ignored.
Models with a normaliser other than identity, without byte fallback or that are not BPE are
refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from labelq.llm.common import bounded, read, small_batches

MARK = "▁"
#: Parts remembered per task (about 150 MB), and the longest one remembered.
CACHE_PARTS = 400_000
CACHE_CHARS = 48
#: Parts after a cut remembered per task.
CACHE_TAILS = 50_000
#: Pair checks remembered per task.
CACHE_PAIRS = 400_000


class Codec:
    """Encoder and decoder of one model; built from the model's bytes, once per task."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if spec.model_type != pb.TrainerSpec.BPE or not spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and a dummy prefix")
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.eos = spec.eos_id
        self.text_of: dict[int, str] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == kinds.NORMAL:
                self.rank[p.piece], self.ids[p.piece] = p.score, i
                self.text_of[i] = p.piece
            elif p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[int, bool] = {}
        #: Runs of letters and digits and of other characters, and the pairs of characters of both kinds that some piece holds.
        self.runs = re.compile(r"[^\W_]+|[\W_]+")
        self.held = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1) if MARK not in p[i:i + 2] and len(self.runs.findall(p[i:i + 2])) > 1}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.tails: dict[str, tuple[str, int, str]] = {}
        # Tokens are numbers: per token its string, size, next shorter token at the same place (-1: none), ids as text and surface,
        # place in the order of merges (characters: below all), and the two tokens of its last merge (characters: itself).
        self.token: dict[str, int] = {}
        self.string: list[str] = []
        self.size: list[int] = []
        self.shorter: list[int] = []
        self.written: list[tuple[str, int, str]] = []
        self.order: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: dict[int, int] = {}  # two tokens: order of the token that their merge makes
        place = {p: i for i, p in enumerate(sorted(self.rank, key=self.rank.get, reverse=True))}
        # Pieces that their own merges do not rebuild never occur in an encoding.
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in sorted(self.rank, key=len):
            if len(p) == 1:
                self.matcher.add_word(p, self.add(p))
            elif len(parts := self.merge(p, last=p)) == 2:
                a, b = self.token[parts[0]], self.token[parts[1]]
                k = self.add(p)
                self.order[k], self.left[k], self.right[k] = place[p], a, b
                self.made[a << 32 | b] = place[p]
                self.matcher.add_word(p, k)
        self.matcher.make_automaton()

    def add(self, p: str) -> int:
        """The number of a new token: a piece, or a character that no piece covers."""
        self.token[p] = k = len(self.string)
        self.string.append(p)
        self.size.append(len(p))
        self.shorter.append(next((self.token[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.token), -1))
        i = self.ids.get(p)
        ids = [self.byte_ids[b] for b in p.encode()] if i is None else [i]
        self.written.append((" ".join(map(str, ids)), len(ids), self.surface(ids)))
        self.order.append(-1 - k)
        self.left.append(k)
        self.right.append(k)
        return k

    def merge(self, text: str, last: str | None = None) -> list[str]:
        """The merges themselves, for short strings: best score first, then leftmost. They stop before the one that makes ``last``."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None or parts[at] + parts[at + 1] == last:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging the joined strings of two tokens gives that pair back; remembered."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.stays(left, right)
        return known

    def stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of tokens ``a`` and ``b``: their merges are undone from the last one on, and the tokens that
        then meet at the border must not make a token before the later merges do."""
        order, made = self.order, self.made
        limit = len(self.rank) + 1
        while True:
            joined = made.get(a << 32 | b)
            if joined is not None and joined < limit:
                return False
            x, y = order[a], order[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.right[a]
            else:  # of equal merges the left one goes first
                limit, b = y + 1, self.left[b]

    def tokens(self, text: str) -> list[int]:
        """The tokens of ``text`` (space marks in place)."""
        k = self.token.get(text)
        if k is not None:
            return [k]
        n = len(text)
        size, shorter, known = self.size, self.shorter, self.pairs
        longest = [-1] * n
        for end, k in self.matcher.iter(text):  # a later end at the same start is a longer match
            longest[end - size[k] + 1] = k
        if -1 in longest:
            token = self.token
            for i, k in enumerate(longest):
                if k < 0:
                    k = token.get(text[i])
                    longest[i] = self.add(text[i]) if k is None else k
        failed = None  # a bit per position, once one has failed
        out: list[int] = []
        pos, last, k = 0, -1, longest[0] if n else -1
        while pos < n:
            end = pos + size[k]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                if last >= 0:
                    fits = known.get(last << 32 | k)
                    if fits is None:
                        fits = self.compatible(last, k)
                else:
                    fits = True
                if fits:
                    out.append(k)
                    pos, last = end, k
                    if pos < n:
                        k = longest[pos]
                    continue
            k = shorter[k]
            if k < 0:
                # Nothing can start here after the last token: mark the position, retry that token shorter.
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError("no valid encoding")
                while k < 0:
                    if not out:
                        raise ValueError("no valid encoding")
                    back = out.pop()
                    pos -= size[back]
                    k = shorter[back]
                    if k < 0:
                        failed[pos >> 3] |= 1 << (pos & 7)
                last = out[-1] if out else -1
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text`` (space marks in place)."""
        return [self.string[k] for k in self.tokens(text)]

    def part(self, part: str) -> tuple[str, int, str]:
        """Ids joined by spaces, their number, and the decoded text of one part."""
        written = self.written
        tokens = self.tokens(part)
        if len(tokens) == 1:
            return written[tokens[0]]
        ids, n, text = zip(*[written[k] for k in tokens])
        return " ".join(ids), sum(n), "".join(text)

    def cut_part(self, x: str) -> tuple[str, int, str]:
        """``part`` of one space mark and ``x``, put together from its runs where no piece holds the characters on both sides of a cut."""
        if x.isalnum():
            return self.part(MARK + x)
        if x[:-1].isalnum() and x[-2:] not in self.held:
            a, b = self.word(x[:-1]), self.tail(x[-1])
            return f"{a[0]} {b[0]}", a[1] + b[1], a[2] + b[2]
        runs = self.runs.findall(x)
        if len(runs) < 2 or MARK in x:
            return self.part(MARK + x)
        if self.held:
            joined = runs[:1]
            for r in runs[1:]:
                if joined[-1][-1] + r[0] in self.held:
                    joined[-1] += r
                else:
                    joined.append(r)
            runs = joined
            if len(runs) < 2:
                return self.part(MARK + x)
        ids, n, text = zip(self.word(runs[0]), *map(self.tail, runs[1:]))
        return " ".join(ids), sum(n), "".join(text)

    def tail(self, x: str) -> tuple[str, int, str]:
        """``part`` of ``x``, which stands after a cut; remembered unless it is long."""
        known = self.tails.get(x)
        if known is None:
            known = self.part(x)
            if len(x) <= CACHE_CHARS:
                if len(self.tails) >= CACHE_TAILS:
                    self.tails.clear()
                self.tails[x] = known
        return known

    def word(self, x: str) -> tuple[str, int, str]:
        """``part`` of one space mark and ``x``, remembered unless it is long. The memory has two halves: words not used while one half fills go."""
        known = self.words.get(x)
        if known is None:
            known = self.older.get(x) or self.cut_part(x)
            if len(x) <= CACHE_CHARS:
                if 2 * len(self.words) >= CACHE_PARTS:
                    self.words, self.older = {}, self.words
                self.words[x] = known
        return known

    def encode_parts(self, text: str | None) -> list[tuple[str, int, str]]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return [self.part(marked)]
        if MARK + MARK in marked or marked[-1] == MARK:
            return [self.word(x[1:]) for x in self.parts.findall(marked)]
        # One mark before each part: a plain split finds them, and known parts are looked up together.
        words = marked[1:].split(MARK)
        out = list(map(self.words.get, words))
        if None in out:
            out = [known or self.word(x) for known, x in zip(out, words, strict=True)]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` with the end id last."""
        return [int(i) for x in self.encode_parts(text) for i in x[0].split(" ")] + [self.eos]

    def surface(self, ids: list[int]) -> str:
        try:
            return "".join([self.text_of[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # byte pieces or control ids among them
            pass
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is None:
                raw += self.text_of.get(i, "").replace(MARK, " ").encode()
            else:
                raw.append(b)
        return raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: pieces joined, byte runs decoded, control ids dropped, the dummy prefix removed."""
        text = self.surface(ids)
        return text[1:] if text[:1] == " " else text


def load_model(path: str) -> bytes:
    """The model file's bytes, read on the driver (about half a megabyte) and sent with the task."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("model file over 64 MB")
    return data


def encode_column(docs: DataFrame, model: bytes, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids and decoded."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made anew in each task (0.2 s) and dropped with it: a worker that lives on keeps no caches.
        c = Codec(shared.value)
        end = str(c.eos)
        ids_of, size_of, text_of = itemgetter(0), itemgetter(1), itemgetter(2)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        for batch in batches:
            doc_id = batch.column(0).to_pylist()
            cols: list[list] = [[] for _ in types]
            for at, value in enumerate(batch.column(1)):
                parts = c.encode_parts(value.as_py())
                ids = " ".join([*map(ids_of, parts), end])
                text = "".join(map(text_of, parts))[1:]
                row = [doc_id[at], sum(map(size_of, parts)) + 1, hashlib.sha256(ids.encode()).hexdigest(),
                       hashlib.sha256(text.encode()).hexdigest()]
                if keep_ids:
                    row += [[int(i) for i in ids.split(" ")], text]
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names[:len(types)])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document under the public 32k BPE model."""
    import public_tokenizers

    return encode_column(read(spark, sf_dir, "documents"), load_model(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}

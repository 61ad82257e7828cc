"""Operator 3, SentencePiece BPE encoding and decoding by a merge-type prefix table.

Greedy merging has a local form: tokens t1..tn are the encoding of their joined text exactly when every
neighbouring pair (a, b) is compatible, that is when merging the text a+b gives [a, b] again. (Merges
inside a span go the same way whatever stands beside it, as long as none crosses its border, and
the first crossing merge would also happen in the pair alone.) So each prefix of a text has one
last token, and that token is the only vocabulary match ending there which is compatible with
the last token of the prefix before it. An Aho-Corasick automaton yields the matches; a table
keeps each prefix's last token; ids are recovered backwards. Time is linear in the text.

No piece of such a model has a word after which a space mark follows, so texts part before space marks;
recurring parts are kept in a bounded memo. A model with such pieces is encoded unparted.

Characters outside the vocabulary become byte pieces, as the model's byte fallback asks. Decoding reads nothing but the ids.

Defined results: null text is empty; an empty text has the end id alone and decodes to the empty string; a very long text is
encoded whole, in memory linear in it; repeated rows and null doc_ids give rows of their own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, slices, table, text_or_empty, vocabulary

SPACE = "▁"
MEMO_PARTS = 600_000
MEMO_PAIRS = 2_000_000
#: Lone surrogates, which no text holds, for ids that aren't plain text: byte b is BYTE_0 + b.
BYTE_0, CONTROL, UNKNOWN = 0xDC00, "\ud800", "\ud801"
BYTE_RUNS = re.compile("[\udc00-\udcff]+").sub


def merge_greedily(text: str, scores: dict[str, float]) -> list[str]:
    """The definition: merge the best-scored neighbouring pair, the leftmost of equals, until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixTable:
    """Encoder of one model for one worker process."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._end = f" {model.eos_id()}"
        pieces = range(model.get_piece_size())
        self.bytes_at = {int(model.id_to_piece(i)[3:5], 16): i for i in pieces if model.is_byte(i)}
        plain = [i for i in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.ids = {model.id_to_piece(i): i for i in plain}
        self._trie = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or merge_greedily(piece, self.scores) == [piece]:
                self._trie.add_word(piece, piece)
        self._trie.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._memo: dict[str, str] = {}
        self._words: dict[str, str] = {}
        self._old: dict[str, str] = {}
        self._spelled = {piece: f"{i} " for piece, i in self.ids.items()}
        self._texts = {str(i): self._text(i) for i in pieces}
        self._parted = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)

    def _text(self, i: int) -> str:
        """What an id stands for in a decoded text; bytes, control and unknown ids are kept as lone surrogates."""
        model, piece = self.library, self.library.id_to_piece(i)
        if model.is_byte(i):
            return chr(BYTE_0 + int(piece[3:5], 16))
        if model.is_control(i):
            return CONTROL
        return UNKNOWN if model.is_unknown(i) else piece.replace(SPACE, " ")

    def _fits(self, a: str, b: str) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            known = merge_greedily(a + b, self.scores) == [a, b]
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    def tokens(self, text: str) -> list[str]:
        """Pieces, and single characters that the vocabulary lacks."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        pairs, fits = self._pairs, self._fits
        for end, piece in self._trie.iter(text):  # longest match first at each end
            end += 1
            if last[end] is None:
                start = end - len(piece)
                # The prefixes up to start are complete, but for characters without any match.
                before = last[start] if start == 0 or last[start] is not None else self._lone(text, last, start)
                if start == 0:
                    last[end] = piece
                else:
                    known = pairs.get((before, piece))
                    if known or known is None and fits(before, piece):
                        last[end] = piece
        out = []
        while n:
            piece = last[n] or text[n - 1]
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    @staticmethod
    def _lone(text: str, last: list[str | None], end: int) -> str:
        last[end] = text[end - 1]
        return text[end - 1]

    def _ids(self, part: str) -> str:
        """Decimal ids of a part, each followed by a space."""
        out = []
        for piece in self.tokens(part):
            known = self.ids.get(piece)
            if known is not None:
                out.append(str(known))
            else:
                out += [str(self.bytes_at[b]) for b in piece.encode()]
        text = " ".join(out) + " "
        if len(part) < 48 and part[1:2] == SPACE:
            if len(self._memo) >= MEMO_PARTS:
                self._memo.clear()
            self._memo[part] = text
        return text

    def _word(self, word: str) -> str:
        """Ids of a word after one space, kept."""
        try:
            spelled = "".join(map(self._spelled.__getitem__, self.tokens(SPACE + word)))
        except KeyError:
            spelled = self._ids(SPACE + word)
        if len(word) < 48:
            if len(self._words) >= MEMO_PARTS // 2:
                self._words, self._old = {}, self._words
            self._words[word] = spelled
        return spelled

    def encode(self, text: str) -> str:
        """Decimal ids joined by single spaces, the end id last."""
        end = self._end[1:]
        if not text:
            return end
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        if self._parted and "" not in words:
            memo, old, word = self._words, self._old, self._word
            return "".join([memo.get(w) or old.pop(w, None) or word(w) for w in words]) + end
        if self._parted:  # runs of spaces, or a space at either end: a run belongs to the word after it
            memo, ids = self._memo, self._ids
            return "".join([memo.get(p) or ids(p) for p in [p.replace(" ", SPACE) for p in re.findall(" *[^ ]+| +$", " " + text)]]) + end
        return self._ids(SPACE + text.replace(" ", SPACE)) + end

    def decode(self, spelled: str) -> bytes:
        """The UTF-8 text of decimal ids joined by single spaces, from the ids alone, as the library's decode(ids) gives it.

        Pieces follow one another with spaces for marks, but for a mark that the text begins with.
        """
        text = "".join(map(self._texts.__getitem__, spelled.removesuffix(self._end).split(" ") if spelled != self._end[1:] else ()))
        try:
            return text.removeprefix(" ").encode()
        except UnicodeEncodeError:  # bytes side by side make characters, unless another id parts them
            text = BYTE_RUNS(_characters, text.lstrip(CONTROL).removeprefix(" "))
            return text.replace(CONTROL, "").replace(UNKNOWN, " \u2047 ").encode()


def _characters(run: re.Match) -> str:
    """A run of bytes read as UTF-8; a byte that has no part in a character becomes a replacement character."""
    raw, out, at = bytes(ord(c) - BYTE_0 for c in run[0]), [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode_documents(docs: DataFrame, path: str, with_texts: bool = False) -> DataFrame:
    """n_tokens and digests of ids and decoded text; with_texts adds the ids and the decoded text themselves."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_texts else "")

    def run(batches):
        encoder = prefix_table(path)
        for batch in batches:
            rows: list[tuple] = []
            for part in slices(batch):
                for doc, text in zip(field(part, "doc_id").to_pylist(), field(part, "text").to_pylist()):
                    spelled = encoder.encode(text)
                    decoded = encoder.decode(spelled)
                    row = (doc, spelled.count(" ") + 1, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, list(map(int, spelled.split(" "))), decoded.decode()) if with_texts else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            columns = list(zip(*rows)) or [()] * (6 if with_texts else 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))

"""Token ids by the tokenizers library, a word at a time.

In a byte-level vocabulary whose splitting rule never joins a space or a line
feed to what stands before it, a text without two neighbouring white spaces can
be encoded piece by piece: every piece begins at a single space or line feed.
Pieces recur, so a worker keeps their ids, and encodes those it has not seen in a
slice of texts by one call.  A piece of letters is a word of the splitting rule, so
the library's model is given such pieces as they stand, many in a text.  Any other
text is encoded whole.  The ids are those of encoding the whole text in either case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clicktide.llm.common import slices

SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NEIGHBOURS = rf"(?:\A|{SPACE})(?:{SPACE}|\z)"  # an end of the text counts as white space
PIECES = 1_200_000  # kept by a worker, about 250 MB
WORDS = 20_000  # encoded as one text
MARKS = ",.;:!?#$%&*|"
ENDS = frozenset(MARKS)
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ӿ"  # letters in any version of Unicode
LETTER = re.compile(f"[{LETTERS}]").fullmatch
WORD = re.compile(rf"[ \n][{LETTERS}]+").fullmatch


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
        # the same model, for words written in the signs of bytes already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        signs = byte_signs()
        space, feed = signs[0x20], signs[0x0A]
        signs[0x09] = " "  # parts words
        self.signs = np.array([*map(ord, signs)], "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in (space, feed)]] = True
        # ids of a piece, as little-endian unsigned 32-bit integers; the key lacks its
        # leading space, with a leading line feed it is as it stands
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts, each encoded as it stands, by few calls."""
        words = {i: t for i, t in enumerate(texts) if WORD(t)}
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(words, self.words([*words.values()]), strict=True):
            out[i] = ids
        others = [i for i in range(len(texts)) if i not in words]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)
        for i, x in zip(others, found):
            out[i] = array("I", x.ids).tobytes()
        return out

    def words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of texts that are a ``WORD`` each, ``WORDS`` of them by one call."""
        out = []
        for low in range(0, len(words), WORDS):
            some = "\t".join(words[low : low + WORDS]).replace("\n", "\n\t")
            written = self.signs[np.frombuffer(some.encode(), "u1")].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            # only the first id of a text holds its space or line feed
            cuts = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def learn(self, unseen: Sequence[str]) -> None:
        """Encode distinct pieces that are not kept, all together."""
        if len(self.pieces) + len(unseen) > PIECES:
            self.pieces.clear()
        # a run of marks after a letter is a token's beginning
        ended = [(p, s, p[len(s) :]) for p in unseen if p[-1] in ENDS and LETTER((s := p.rstrip(MARKS))[-1:])]
        stems = {s for _, s, _ in ended}
        marks = [*{m for _, _, m in ended}]
        plain = [*stems.union(unseen).difference([p for p, _, _ in ended], self.pieces.keys() & stems)]
        found = self.whole([*(p if p[0] == "\n" else f" {p}" for p in plain), *marks])
        self.pieces.update(zip(plain, found))
        tails = dict(zip(marks, found[len(plain) :]))
        self.pieces.update([(p, self.pieces[s] + tails[m]) for p, s, m in ended])

    def ids(self, wanted: Sequence[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = [*map(self.pieces.get, wanted)]
        unseen = [i for i, x in enumerate(found) if x is None]
        self.learn([wanted[i] for i in unseen])
        for i in unseen:
            found[i] = self.pieces[wanted[i]]
        return found

    def by_pieces(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        """All ids of texts without two neighbouring white spaces."""
        feed, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        parted = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(feed, parted, nothing), " ")
        pieces = cut.flatten().dictionary_encode()
        distinct = self.ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, raw = pa.array(distinct, pa.large_binary()).take(pieces.indices).buffers()
        bounds = np.frombuffer(ends, "<i8")[cut.offsets.to_numpy()].tolist()
        view = memoryview(raw)
        for low, high in zip(bounds, bounds[1:]):
            yield bytes(view[low + 4 : high])  # without the line feed put in front

    def all_ids(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """All ids of each text, four bytes each; a null text has none."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        out: list[bytes] = [b""] * len(column)
        close = pc.match_substring_regex(column, NEIGHBOURS)  # null for a null
        at = pc.indices_nonzero(pc.invert(close))
        if len(at):
            for i, ids in zip(at.to_pylist(), self.by_pieces(column.take(at))):
                out[i] = ids
        at = pc.indices_nonzero(close)
        for i, ids in zip(at.to_pylist(), self.whole(column.take(at).to_pylist())):
            out[i] = ids
        return out


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes]]:
    """``doc_id`` (first column) and ids of ``text`` of every row, a slice of texts at a time."""
    encode = encoder(path).all_ids
    for batch in batches:
        for part in slices(batch, "text"):
            yield from zip(part.column(0).to_pylist(), encode(part.column("text")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)

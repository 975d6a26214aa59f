"""Token ids of texts by a ``tokenizers`` file, each distinct word encoded by the library once per worker.

Both supported pre-tokenizers treat the parts between white space on their own, so a text's ids are the ids of
its parts in order. Where that does not hold (two white-space characters in a row, an unknown kind of file) the
whole text goes to the library. Texts are split, and their words numbered, by Arrow; ids are put together by numpy.
"""

from __future__ import annotations

import gc
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker unless a caller says otherwise, in two generations: when the younger is half of it, the older one goes and
#: takes the words with it that were not met since. So memory is bounded whatever the corpus, and common words stay.
MEMO_WORDS = 800_000
#: Longer words are encoded each time and not kept.
MEMO_CHARS = 40
#: Bytes of text worked through at a time; a longer text is cut at white space.
GROUP_BYTES = 4_000_000

#: Two characters of Unicode white space.
_TWO_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Signs behind a word; up to three of them are one pre-token. The letters before, up to ÿ, are stable under NFC.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level files write the bytes outside printable Latin-1 as the characters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}
_loaded: dict[str, WordTokenizer] = {}


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordTokenizer:
    """``encode(text)`` gives ids as little-endian unsigned 32-bit bytes, equal to the library's for every text."""

    def __init__(self, path: str, memo_words: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.memo_words = MEMO_WORDS if memo_words is None else memo_words
        described = json.loads(self.library.to_str())
        pre, norm = described.get("pre_tokenizer") or {}, described.get("normalizer")
        split = (pre.get("pretokenizers") or [{}])[0]
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
        elif split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and r"[^\s" in (split.get("pattern") or {}).get("Regex", ""):
            self.kind = "bare"
        else:
            self.kind = "whole"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model, self.tails, self.newline = self.library.model, {"": b""}, self._whole("\n")
        self.table = [_pack([i]) for i in range(self.library.get_vocab_size(with_added_tokens=True))]

    def _whole(self, text: str) -> bytes:
        return _pack(self.library.encode(text, add_special_tokens=False).ids)

    def _make(self, units: list[str]) -> list[bytes]:
        """Ids of units that the memo lacks: plain letters with punctuation behind straight from the library's
        model, all others through its whole chain. A unit of the spaced kind has a space before it or begins with a line feed."""
        spaced, young, old, tails, table, tokenize = self.kind == "spaced", self.young, self.old, self.tails, self.table, self.model.tokenize
        out: list[bytes] = []
        rest: list[tuple[int, bytes, str]] = []
        for i, u in enumerate(units):
            if u.isalpha():
                head, before, key, stem, tail = b"", "Ġ" if spaced else "", u, u, ""
            else:
                begins = spaced and u[:1] == "\n"
                head, before, body = (self.newline, "", u[1:]) if begins else (b"", "Ġ" if spaced else "", u)
                stem = body.rstrip(_SIGNS)
                tail = body[len(stem) :]
                key = u[: len(u) - len(tail)]
            if not stem.isalpha() or len(tail) > 3 or not stem.isascii() and max(stem) > "ÿ":
                whole = u[1:] if head else (" " + u if spaced else u)
                out.append(head)
                rest.append((i, head, whole))
                continue
            ids = young.get(key) or old.get(key)
            if ids is None:
                s = stem if spaced else stem.lower()
                s = s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = head + b"".join([table[x.id] for x in tokenize(before + s)])
                if tail and len(key) <= MEMO_CHARS:
                    young[key] = ids
            if tail not in tails:
                tails[tail] = self._whole(tail)
            out.append(ids + tails[tail])
        found = self.library.encode_batch_fast([x[2] for x in rest], add_special_tokens=False)
        for (i, head, _), e in zip(rest, found):
            out[i] = head + _pack(e.ids)
        return out

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        out = list(map(self.young.get, units))
        young, old, new = self.young, self.old, []
        for i in [i for i, x in enumerate(out) if x is None]:
            ids = out[i] = old.get(units[i])
            if ids is None:
                new.append(i)
            else:
                young[units[i]] = ids
        for i, ids in zip(new, self._make([units[i] for i in new])):
            out[i] = ids
            if len(units[i]) <= MEMO_CHARS:
                young[units[i]] = ids
        if len(young) > self.memo_words // 2:
            self.old, self.young = young, {}
        return out

    def _group(self, texts: pa.Array, opens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts end to end, and how many each has. ``opens`` is false for the later parts of a text, which begin
        with white space."""
        if self.kind == "bare":
            units = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            # white space stands alone here: a line feed goes with the word behind it, so that each unit's ids are its own
            led = pc.binary_join_element_wise("\n", texts, "") if opens else texts
            units = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        lists = units.offsets.to_numpy()
        coded = units.flatten().dictionary_encode()
        codes, blobs = coded.indices.to_numpy(), self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        each = sizes[codes]
        if self.kind == "spaced":
            each[lists[:-1]] = 0  # nothing stands before the first white space
        ends = np.concatenate([[0], np.cumsum(each)])
        begin = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(begin[codes] - ends[:-1], each) + np.arange(ends[-1])]
        at, counts = ends[lists[:-1]], ends[lists[1:]] - ends[lists[:-1]]
        if self.kind == "spaced" and opens:  # the line feed put before each text
            k = len(self.newline) // 4
            ids, counts = np.delete(ids, (at[:, None] + np.arange(k)).reshape(-1)), counts - k
        return ids, counts

    def _long(self, text: str) -> np.ndarray:
        """Ids of one long text, in parts that begin with white space."""
        parts, at = [], 0
        while at < len(text):
            upto = at + GROUP_BYTES // 4
            cuts = [x for x in (text.find(" ", upto), text.find("\n", upto)) if x >= 0]
            upto = min(cuts) if cuts and upto < len(text) else len(text)
            parts.append(self._group(pa.array([text[at:upto]]), at == 0)[0])
            at = upto
        return np.concatenate(parts)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) end to end, and how many each text has; worked through in groups of bounded size."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy()
        alone = sizes > GROUP_BYTES
        odd = np.full(len(texts), self.kind == "whole")
        if self.kind == "spaced":
            odd = pc.match_substring_regex(texts, _TWO_SPACES).to_numpy(zero_copy_only=False)
        alone |= odd
        ids, counts, at = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            upto, size = at + 1, int(sizes[at])
            if alone[at]:
                text = texts[at].as_py()
                own = np.frombuffer(self._whole(text), "<u4") if odd[at] else self._long(text)
                n = np.array([len(own)])
            else:
                while upto < len(texts) and not alone[upto] and size + sizes[upto] <= GROUP_BYTES:
                    size += int(sizes[upto])
                    upto += 1
                own, n = self._group(texts.slice(at, upto - at))
            ids.append(own)
            counts.append(n)
            at = upto
        return np.concatenate(ids), np.concatenate(counts)

    def encode_many(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        ids, counts = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def load(path: str, memo_words: int | None = None) -> WordTokenizer:
    """The worker's tokenizer for a file, loaded once per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 20, 100)  # the memo holds no cycles, and going through it costs
        _loaded[path] = WordTokenizer(path, memo_words)
    return _loaded[path]

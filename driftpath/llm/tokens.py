"""Token ids by the tokenizers library, with a bounded cache of what it has encoded before.

Both vocabularies split a text into pre-tokens and encode each by itself, and none of these spans a blank between words, so
what stands between two blanks (a chunk) needs to be encoded once. Chunks are cut, told apart and put together again by
Arrow and NumPy. The split is written here for texts of Latin characters up to U+017F with single blanks; any other text
goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

# The pre-token pattern of the public word vocabulary, over characters up to U+017F.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_OTHER = re.compile("[^\x00-\x7f¡-¬®-įı-ſ]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f")
_LONGEST = 200
_CACHED = 800_000
_STEP = 1 << 23
_AT_ONCE = 1 << 19
_LOADED: dict[str, _Encoder] = {}


class _Encoder:
    def __init__(self, path: str) -> None:
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.t.no_truncation()
        self.t.no_padding()
        self.kind = {"byte_bpe_50k.json": "bytes", "word_bpe_49k.json": "words"}.get(os.path.basename(path))
        vocab = self.t.get_vocab(with_added_tokens=True)
        #: By id: whether a chunk begins (bytes) or a pre-token ends (words) with it.
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for w, i in vocab.items() if (w[0] in "ĠĊ" if self.kind == "bytes" else w.endswith("</w>"))]] = True
        #: Chunks known, by number; their ids lie in one array.
        self.known: dict[str, int] = {}
        self.ids, self.first, self.size = np.empty(0, "<u4"), np.empty(0, "i8"), np.empty(0, "i8")

    def raw(self, texts: list[str]) -> list:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4") for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def even(self, text: str) -> bool:
        """Whether blanks alone split the text into chunks; the library has to split any other."""
        if self.kind is None or not text.isascii() and _OTHER.search(text) or not text.isprintable() and _CONTROL.search(text):
            return False
        return self.kind == "words" or not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _UNEVEN))

    def learn(self, new: list[str]) -> None:
        """Encode chunks: many together in one text, cut where one begins or ends; those that begin a text by themselves."""
        import numpy as np

        if self.kind == "bytes":
            alone = [k for k in new if k[0] == "\r"]
            new = [k for k in new if k[0] != "\r"]
            found = self.raw(["".join(k if k[0] == "\n" else " " + k for k in new[i : i + 2000]) for i in range(0, len(new), 2000)])
            found = np.concatenate(found) if found else self.ids[:0]
            first = np.flatnonzero(self.edge[found])
            whole = len(first) == len(new)
        else:
            alone = [k for k in new if not k]
            new = [k for k in new if k]
            found = self.raw([" ".join(new[i : i + 2000]) for i in range(0, len(new), 2000)])
            found = np.concatenate(found) if found else self.ids[:0]
            ends = np.flatnonzero(self.edge[found]) + 1
            parts = np.cumsum(np.fromiter((1 if k.isalpha() else len(_WORDS.findall(k)) for k in new), "i8", len(new)))
            whole = not new or len(ends) == parts[-1]
            if whole and new:
                first = np.append(0, ends[parts[:-1] - 1])
        if not whole:
            alone, new, found = new + alone, [], found[:0]
        single = self.raw([k[1:] if k[:1] == "\r" else " " + k if self.kind == "bytes" and k[0] != "\n" else k for k in alone])
        if not new:
            first = np.empty(0, "i8")
        n = np.fromiter(map(len, single), "i8", len(single))
        starts = np.append(first, len(found) + np.cumsum(n) - n)
        found = np.concatenate([found, *single])
        self.known.update(zip(new + alone, range(len(self.first), len(self.first) + len(starts)), strict=True))
        self.first = np.append(self.first, starts + len(self.ids))
        self.size = np.append(self.size, np.diff(starts, append=len(found)))
        self.ids = np.append(self.ids, found)

    def forget(self) -> None:
        """Keep short chunks, which come again soonest, if they are few enough."""
        import numpy as np

        short = [k for k in self.known if len(k) <= 9]
        if len(short) >= _CACHED // 2:
            short = []
        at = np.fromiter(map(self.known.__getitem__, short), "i8", len(short))
        self.ids = self.gather(at)
        self.size = self.size[at]
        self.first = np.cumsum(self.size) - self.size
        self.known = dict(zip(short, range(len(short)), strict=True))

    def gather(self, chunks):
        """Ids of the chunks of these numbers, one after another."""
        import numpy as np

        out = np.empty(int(self.size[chunks].sum()), "<u4")
        at = 0
        for k in range(0, len(chunks), _AT_ONCE):
            size = self.size[chunks[k : k + _AT_ONCE]]
            ends = np.cumsum(size)
            n = int(ends[-1])
            out[at : at + n] = self.ids[np.repeat(self.first[chunks[k : k + _AT_ONCE]] - ends + size, size) + np.arange(n)]
            at += n
        return out

    def some(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Each distinct chunk of them all is looked up once; its ids are then gathered for each place."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [b""] * len(texts)
        even = []
        for i, x in enumerate(texts):
            if x and self.even(x):
                even.append(i)
            elif x:
                out[i] = self.raw([x])[0].tobytes()
        if not even:
            return out
        if self.kind == "words":
            cut = pc.ascii_split_whitespace(pa.array([" ".join(texts[i].lower().split()) for i in even], pa.large_string()))
        else:
            cut = pc.split_pattern(pa.array(["\r" + texts[i].replace("\n", " \n") for i in even], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > _CACHED or len(self.ids) > 8 * _CACHED:
            self.forget()
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), "i8", len(chunks))
        missing = np.flatnonzero(number < 0)
        new = [chunks[i] for i in missing.tolist()]
        if new:
            self.learn(new)
            number[missing] = np.fromiter(map(self.known.__getitem__, new), "i8", len(new))
        for k in new:
            if len(k) > _LONGEST:
                del self.known[k]
        place = number[coded.indices.to_numpy()]
        ends = np.append(0, np.cumsum(self.size[place]))[cut.offsets.to_numpy()].tolist()
        ids = self.gather(place)
        for k, i in enumerate(even):
            out[i] = ids[ends[k] : ends[k + 1]].tobytes()
        return out


def encoded(path: str, texts: Iterable[str | None]) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, in order; a null text has none."""
    if path not in _LOADED:
        _LOADED[path] = _Encoder(path)
    held: list[str] = []
    size = 0
    for x in texts:
        held.append(x or "")
        size += len(held[-1])
        if size >= _STEP:
            yield from _LOADED[path].some(held)
            held, size = [], 0
    if held:
        yield from _LOADED[path].some(held)

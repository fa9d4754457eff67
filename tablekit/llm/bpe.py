"""BPE encoding and decoding (operator 1): a bounded-lookahead streaming transducer.

For every prefix of a word the transducer keeps one number: the last token of that
prefix's BPE encoding. A token may follow another one exactly when BPE leaves the two
alone, so the encoding of a prefix is found from those of the shorter prefixes, longest
candidate first. The encodings of all prefixes form a tree. Whatever follows, the next
token starts within the longest token's length of the end, so the part of the tree's path
shared by those live positions is final: it is emitted and forgotten. How far behind the
end that part can lie is the merge list's sufficient lookahead (``BpeModel.lookahead``):
text on the right can undo a merge only along a chain of touching merges of rising rank.

The cut into words (normaliser, pre-tokeniser, special tokens) is that of the tokenizer
file; only the classes found in it are supported, others raise. ``encode`` and ``decode``
work per row in Arrow batches, without a shuffle.

Defined cases: a null text is encoded as the empty text (no ids; decoded text ""); null
ids are decoded as no ids; all other columns pass through unchanged, a column of the
output's name is replaced; empty tables give empty tables.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Words and pairs remembered by one Python worker; older ones are forgotten.
CACHE_ENTRIES = 1 << 19
ROWS_AT_ONCE = 512
#: Keys of an automaton's state beside its symbols.
ENDS, LESS, DEPTH = 0, 1, 2
#: White space to str.split(), but not to the tokenizer's pattern.
SPLIT_APART = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[^\\S\x1c-\x1f]+")
#: A full stop or comma beside another sign: they are one word.
TOUCHING = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: Stands for a chunk that this Python's character tables do not cover.
WILD = b"?wild"


def byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Memo(dict):
    """Remembers values in two generations: when the young one is full it becomes the old
    one, from which only what is asked for again comes back. Constant memory."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def has(self, key) -> bool:
        return key in self or key in self.old

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def __missing__(self, key):
        value = self.old.pop(key, None)
        return self.keep(key, self.make(key) if value is None else value)


class BpeModel:
    """A merge list with its vocabulary, read from a tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError(f"{path}: only byte-level BPE models are supported")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.longest = max(len(self._bare(t)) for t in self.vocab)
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.chars = byte_chars()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self._merges(model["merges"])
        self._normal(spec.get("normalizer"))
        self._pieces(spec.get("pre_tokenizer"))
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.follows = Memo(lambda key: self.apart(key >> 32, key & 0xFFFFFFFF), 1 << 20)
        self.words = Memo(self._encode_new)

    def _merges(self, merges) -> None:
        """rank: of a pair of ids; parts, made: the pair and the rank that make a token;
        stands: the tokens that BPE makes of their own text."""
        vocab = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = dict.fromkeys(vocab.values(), -1)
        stands = {vocab[c + e] for c in self.chars for e in ("", self.end) if c + e in vocab}
        for r, m in enumerate(merges):
            x, y = m.split(" ") if isinstance(m, str) else m
            pair, t = (vocab[x], vocab[y]), vocab[x + y]
            self.rank.setdefault(pair, r)
            if self.made[t] < 0:
                self.parts[t], self.made[t] = pair, r
                if pair[0] in stands and pair[1] in stands and self.apart(*pair, r):
                    stands.add(t)
        self.stands = stands

    @cached_property
    def start(self) -> dict:
        """An automaton over symbols whose states are the beginnings of tokens: the state
        after a text is its longest end that begins a token. ENDS lists the tokens that end
        there, longest first, LESS is the state of the next shorter end. Moves that are not
        along a token are added when they are first made."""
        start = {ENDS: (), DEPTH: 0}
        for t, i in self.vocab.items():
            if i in self.stands:
                node, symbols = start, self._symbols(t)
                for d, c in enumerate(symbols, 1):
                    node = node.setdefault(c, {DEPTH: d, ENDS: ()})
                node[ENDS] = ((i, len(symbols)),)
        start[LESS] = start
        level = [start]
        while level:
            below = []
            for node in level:
                for c in [c for c in node if isinstance(c, str)]:
                    child = node[c]
                    less = node[LESS]
                    while less is not start and c not in less:
                        less = less[LESS]
                    child[LESS] = less[c] if c in less and less[c] is not child else start
                    child[ENDS] += child[LESS][ENDS]
                    below.append(child)
            level = below
        return start

    def move(self, state: dict, symbol: str) -> dict:
        """The state after ``symbol`` where no token goes on: that of a shorter end."""
        at = state
        while symbol not in at and at is not self.start:
            at = at[LESS]
        state[symbol] = to = at.get(symbol, self.start)
        return to

    def apart(self, x: int, y: int, limit: float = float("inf")) -> bool:
        """Whether BPE leaves two tokens alone that stand side by side. Goes back in time,
        undoing the later of the merges that made the two touching parts; the parts would
        have merged if their pair came before the merge undone last."""
        rank, made, parts = self.rank, self.made, self.parts
        while True:
            r = rank.get((x, y))
            if r is not None and r < limit:
                return False
            if made[x] < 0 and made[y] < 0:
                return True
            if made[x] > made[y]:
                limit = made[x]
                x = parts[x][1]
            else:  # of equal pairs the left one goes first
                limit = made[y] + 1
                y = parts[y][0]

    def _normal(self, spec) -> None:
        kinds = [n["type"] for n in (spec["normalizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else [])]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {kinds} are not supported")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds

    def _pieces(self, spec) -> None:
        import regex

        parts = spec["pretokenizers"] if spec and spec["type"] == "Sequence" else [spec]
        cut = [p for p in parts if p["type"] == "Split"]
        if len(cut) != 1 or not cut[0]["invert"] or cut[0]["behavior"] != "Removed" or r"[^\s\p{L}\p{N}]+" not in cut[0]["pattern"]["Regex"]:
            raise ValueError("the pre-tokenizer must cut at white space")
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"], regex.V0)

    def _bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and len(token) > len(self.end) else token

    def _symbols(self, token: str) -> list[str]:
        bare = self._bare(token)
        return [*bare[:-1], bare[-1] + self.end] if bare != token else list(token)

    @property
    def lookahead(self) -> int:
        """Symbols behind the end from which on no later text changes the encoding. A merge
        that text on the right makes or undoes touches on its left only merges of a higher
        rank, each at most a token further left: the longest such chain bounds the change."""
        if not hasattr(self, "_lookahead"):
            reach: dict[int, int] = {}
            most = 0
            for (a, b), r in sorted(self.rank.items(), key=lambda x: -x[1]):
                t = self.vocab.get(self.tokens[a] + self.tokens[b])
                here = len(self._bare(self.tokens[a])) + max(reach.get(x, 0) for x in (a, b, t))
                most = max(most, here)
                for x in (a, b):
                    reach[x] = max(reach.get(x, 0), here)
            self._lookahead = most + self.longest
        return self._lookahead

    def encode_batch(self, texts, library: bool = False) -> list[bytes]:
        """Whole texts to ids as little-endian unsigned 32-bit integers. The distinct words
        of all texts are looked up; new ones are encoded in order, so that each goes on from
        the prefix it shares with the one before it (``library``: by the tokenizers library).
        The texts' ids are then gathered from the words'."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [self.normalised(t) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array([t or "" for t in plain], pa.large_string()))
        word = lists.flatten().dictionary_encode()
        distinct = word.dictionary.to_pylist()
        self._learn(distinct, library)
        ids = [self.words[w] for w in distinct]
        wild = {i for i, x in enumerate(ids) if x is WILD}
        ids = [b"" if x is WILD else x for x in ids] if wild else ids
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        data, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = word.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        flat = data[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        out = []
        for i, t in enumerate(texts):
            if plain[i] is None:
                out.append(self._apart(t, library))
            elif wild and wild & set(at[lists.offsets[i].as_py() : lists.offsets[i + 1].as_py()].tolist()):
                out.append(self._whole(t))
            else:
                out.append(flat[bounds[i] : bounds[i + 1]].tobytes())
        return out

    def _learn(self, chunks, library: bool) -> None:
        new = {c: self._words(c) for c in chunks if not self.words.has(c)}
        if new:
            (self._by_library if library else self._in_order)(new)

    def normalised(self, text: str) -> str | None:
        """A text in normal form, full stops and commas that stand alone cut off as words.
        None for the rare texts with special tokens or separators that are white space only
        to Python."""
        if self._special and "<" in text and self._special.search(text) or SPLIT_APART.search(text):
            return None
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # character by character: str.lower() on a word treats a final sigma apart
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text if TOUCHING.search(text) else text.replace(".", " . ").replace(",", " , ")

    def _apart(self, text: str, library: bool) -> bytes:
        """Encodes a text between its special tokens and separators: no word holds either."""
        out = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif SPLIT_APART.search(part):
                # U+001C to U+001F are signs to the tokenizer, words with what touches them
                for p in SPACE.split(unicodedata.normalize("NFC", part) if self.nfc else part):
                    if p:
                        chunk = "".join(map(str.lower, p)) if self.lower else p
                        out.append(self._whole(p) if WILD in self._words(chunk) else self.words[chunk])
            else:
                out.append(self.encode_batch([part], library)[0])
        return b"".join(out)

    def _in_order(self, new: dict[str, list[str]]) -> None:
        run, text, often = Transducer(self), "", 2 * self.longest
        for w in sorted(w for w in set().union(*new.values()) - {WILD} if not self.words.has(w)):
            before, text = text, self.symbols(w)
            if len(text) > often:
                run, text = Transducer(self), ""
                continue  # encoded when it is needed, as a stream
            k, most = 0, min(len(before), len(text)) - 1
            while k < most and before[k] == text[k]:
                k += 1
            run.rewind(k)
            run.run(text[k:-1])
            run.run((text[-1] + self.end,))
            self.words.keep(w, array("I", run.path(len(text))).tobytes())
        for c, words in new.items():
            if words != [c]:
                self.words.keep(c, self._joined(c, words))

    def _by_library(self, new: dict[str, list[str]]) -> None:
        tokenize = self.library.model.tokenize
        for c, words in new.items():
            if WILD in words:
                self.words.keep(c, self._joined(c, words))
            else:
                self.words.keep(c, array("I", [t.id for w in words for t in tokenize(self.symbols(w))]).tobytes())

    def _encode_new(self, chunk: str) -> bytes:
        words = self._words(chunk)
        if words == [chunk]:
            run = Transducer(self)
            return array("I", run.feed(self.symbols(chunk)) + run.finish()).tobytes()
        return self._joined(chunk, words)

    def _joined(self, chunk: str, words: list[str]) -> bytes:
        if WILD in words:
            return WILD
        return b"".join([self.words[w] for w in words])

    def _words(self, chunk: str) -> list[str]:
        if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
            return [WILD]
        return self.pattern.findall(chunk)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> bytes:
        """A text with characters newer than this Python's tables: the library normalises and
        cuts it, word by word."""
        out = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                run = Transducer(self)
                out.append(array("I", run.feed(w) + run.finish()).tobytes())
        return b"".join(out)

    def symbols(self, word: str) -> str:
        return "".join(map(self.chars.__getitem__, word.encode("utf-8")))


class Transducer:
    """Streams one word's symbols in and its stable tokens out.

    ``last[i]`` is (token, start) of the last token of the prefix that ends with symbol i,
    ``states[i]`` the automaton's state after i symbols. Positions count from the end of the
    emitted tokens.
    """

    def __init__(self, model: BpeModel):
        self.m, self.held = model, ""
        self.last: list[tuple[int, int]] = []
        self.states: list[dict] = [model.start]
        self.before = -1  # the last emitted token
        self.most = 0  # the longest that ``last`` has been

    def run(self, symbols) -> None:
        """Of the tokens that may end at a symbol, one continues the encoding of what
        stands before it."""
        last, states, follows, before = self.last, self.states, self.m.follows, self.before
        n, state = len(last), states[-1]
        for c in symbols:
            n += 1
            to = state.get(c)
            state = self.m.move(state, c) if to is None else to
            for t, size in state[ENDS]:
                j = n - size
                if j >= 0:
                    left = last[j - 1][0] if j else before
                    if left < 0 or follows[left << 32 | t]:
                        break
            last.append((t, j))
            states.append(state)

    def rewind(self, n: int) -> None:
        """Back to the state after n symbols."""
        del self.last[n:], self.states[n + 1 :]

    def path(self, i: int) -> list[int]:
        out = []
        while i:
            t, i = self.last[i - 1]
            out.append(t)
        return out[::-1]

    def feed(self, symbols: str) -> list[int]:
        """Takes symbols; the ids that are now certain."""
        if not symbols:
            return []
        symbols, self.held = self.held + symbols[:-1], symbols[-1]
        often, out = 2 * self.m.longest, []
        for i in range(0, len(symbols), often):
            self.run(symbols[i : i + often])
            self.most = max(self.most, len(self.last))
            if len(self.last) > often:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Emits the path that all live positions share: any next token starts at one of them."""
        n, state = len(self.last), self.states[-1]
        live = {n}
        while state[DEPTH]:  # every end of the text that begins a token
            live.add(max(0, n - state[DEPTH]))
            state = state[LESS]
        while len(live) > 1:
            i = max(live)
            live.discard(i)
            live.add(self.last[i - 1][1])
        root = live.pop()
        if root:
            path = self.path(root)
            self.before = path[-1]
            self.last = [(t, j - root) for t, j in self.last[root:]]
            del self.states[:root]
            return path
        return []

    def finish(self) -> list[int]:
        """The remaining ids: the held symbol ends the word."""
        if not self.held:
            return []
        self.run([self.held + self.m.end])
        self.held = ""
        return self.path(len(self.last))


class Detokeniser:
    """Ids in, text out as soon as it is certain.

    ``surface``: what a tokenizer file without a decoder gives, the tokens joined by one
    space. ``text``: the bytes behind the tokens through an incremental UTF-8 state
    machine, one space at a word's end."""

    def __init__(self, model: BpeModel, form: str = "surface"):
        import codecs

        self.m, self.form, self.first = model, form, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if self.form == "surface":
            out = " ".join(map(self.m.tokens.__getitem__, ids))
            if out and not self.first:
                out = " " + out
            self.first = self.first and not out
            return out
        out = []
        for i in ids:
            t = self.m.tokens[i]
            bare = self.m._bare(t)
            if t in self.m.special:
                out.append(self.utf8.decode(b"", True) + t)
                self.utf8.reset()
                continue
            out.append(self.utf8.decode(bytes(map(self.m.bytes.__getitem__, bare)), bare != t))
            if bare != t:
                self.utf8.reset()
                out.append(" ")
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    """One model per Python worker and file."""
    out = BpeModel(path)
    gc.collect()
    gc.freeze()  # the tables need no more passes of the collector
    return out


def _with(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [f for f in df.schema.fields if f.name != name]
    return StructType([*kept, StructField(name, _parse_datatype_string(kind), False)])


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", form: str = "array", keep_text: bool = True) -> DataFrame:
    """Add ``out``: the ids of ``text_col`` as array<bigint>, or with form="binary" packed
    as little-endian unsigned 32-bit integers. ``keep_text=False`` drops the text."""
    import pyarrow as pa

    src = df if keep_text or out == text_col else df
    names = [c for c in df.columns if c != out and (keep_text or c != text_col)]
    schema = _with(src.select(*[F.col(f"`{c}`") for c in names]), out, "binary" if form == "binary" else "array<bigint>")

    def run(batches):
        import numpy as np

        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                packed = m.encode_batch(texts)
                if form == "binary":
                    ids = pa.array(packed, pa.binary())
                else:
                    flat = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) // 4 for x in packed]]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], ids], [*names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", form: str = "surface") -> DataFrame:
    """Add ``out``: the text of ``ids_col`` (array or packed ids), in blocks of ids."""
    import pyarrow as pa

    names = [c for c in df.columns if c != out]
    schema = _with(df, out, "string")
    block = 1 << 16

    def text(m, ids) -> str:
        import numpy as np

        if ids is None:
            return ""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
        d = Detokeniser(m, form)
        return "".join([*(d.feed(ids[i : i + block].tolist()) for i in range(0, len(ids), block)), d.finish()])

    def run(batches):
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                got = [text(m, x) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(got, pa.string())], [*names, out])

    return df.mapInArrow(run, schema)

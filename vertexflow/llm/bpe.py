"""BPE encoding and decoding through a tokenization automaton.

The automaton reads *tokens*: it accepts a token sequence exactly if that sequence is what the ranked
merges make of the characters it spells. It starts as one state per base symbol, all symbols allowed
everywhere. Merge number i of (u, v) into w then adds one *merge gadget*:

* the arc v leaves the state reached by u (after u alone, v would have been merged);
* a state for w appears, a snapshot of the state of v at this moment;
* every state with an arc u (whose target has the arc v) gains an arc w to the new state.

Doing this in rank order gives a deterministic automaton with one state per token. Its tables are kept
compact: a state stores only the arcs cut from it and the state it is a snapshot of; an arc w exists
where the arc of its left part existed when w was made.

Words are read symbol by symbol through a transition table. What can still become a token after some symbols is a set of
(token before, symbols since); these sets are the states of the table, filled in when first reached (beyond `most_states` the
table starts anew). Every prefix has exactly one accepted token sequence, so each state knows its last token, and the
tokens of a word are read off backwards from its end: no search, no dead ends. Decoding emits the labels of the arcs.

Null texts count as empty: no tokens, the digests of the empty string. Empty tables give empty results;
rows are treated one by one, so ties and repeated rows change nothing; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, arrow_batch, arrow_rows, lean

#: White space as the tokenizer files understand \s (Unicode White_Space).
_SPACE = "\x09-\x0d\x20\x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_SPACE}]+")
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_ALL = 1 << 60
LAST, OPEN, ENDS = -1, -2, -3


class MergeAutomaton:
    """vocab: token -> id. merges: pairs of tokens in rank order. suffix: what marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "", most_states: int = 250_000):
        self.suffix, self.label, self.most_states = suffix, {i: t for t, i in vocab.items()}, most_states
        self.cut: dict[int, dict[int, int]] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for i, pair in enumerate(merges):
            u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self._gadget(i, u, v, vocab[self.label[u] + self.label[v]])
        self.size = {i: self._symbols(t) for i, t in self.label.items()}
        reachable = {i: t for i, t in self.label.items() if i in self.parts or self.size[i] == 1}
        self.final = {t[: len(t) - len(suffix)]: i for i, t in reachable.items() if suffix and t.endswith(suffix)}
        self.inner = {t: i for i, t in reachable.items() if not (suffix and t.endswith(suffix))}
        if not suffix:
            self.final = self.inner
        self.prefixes = {t[:k] for t in {*self.final, *self.inner} for k in range(len(t))}
        self._known: dict[int, bool] = {}
        self._restart()

    def _symbols(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def _gadget(self, i: int, u: int, v: int, w: int) -> None:
        if w in self.parts:
            raise ValueError(f"two merges make {self.label[w]!r}; their states would share a label")
        if not self.arc(u, v):
            return  # an earlier merge already keeps u and v from meeting
        self.parts[w], self.born[w] = (u, v), i
        self.cut.setdefault(u, {})[v] = i

    def arc(self, state: int, token: int) -> bool:
        """Whether the token may follow in this state."""
        at = _ALL
        while True:
            own, before = state, _ALL
            while True:
                cut = self.cut.get(own)
                if cut is not None and (i := cut.get(token, _ALL)) < before and i <= at:
                    return False
                if own not in self.parts:
                    break
                before, own = min(before, self.born[own]), self.parts[own][1]
            if token not in self.parts:
                return True
            at, token = min(at, self.born[token]), self.parts[token][0]

    def _follows(self, state: int, token: int) -> bool:
        if state < 0:
            return True
        key = state << 32 | token
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 300_000:
                self._known.clear()
            known = self._known[key] = self.arc(state, token)
        return known

    def _restart(self) -> None:
        """The table of symbol transitions with its start state alone. A state is the set of (token before, symbols since) that can still grow;
        its row maps symbols to rows, LAST to its last token, OPEN to that set and ENDS to the last tokens by final symbol."""
        self.start = {LAST: -1, OPEN: ((-1, ""),), ENDS: {}}
        self.rows = {self.start[OPEN]: self.start}

    def _read(self, row: dict, symbol: str) -> dict:
        """Fills in one transition: the last token of what has been read is the one that ends here and may follow the token before it."""
        grown, last = [], -1
        for before, part in row[OPEN]:
            part += symbol
            token = self.inner.get(part)
            if token is not None and self._follows(before, token):
                last = token
            if part in self.prefixes:
                grown.append((before, part))
        if last < 0:
            raise ValueError(f"no token for the symbol {symbol!r}")
        key = (*grown, (last, ""))
        to = self.rows.get(key)
        if to is None:
            to = self.rows[key] = {LAST: last, OPEN: key, ENDS: {}}
        row[symbol] = to
        return to

    def _end(self, row: dict, symbol: str) -> int:
        """The last token of a word that ends with this symbol."""
        for before, part in row[OPEN]:
            token = self.final.get(part + symbol)
            if token is not None and self._follows(before, token):
                row[ENDS][symbol] = token
                return token
        raise ValueError(f"no token ends a word with {symbol!r}")

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word, given in byte letters: one transition a symbol, then back along the last tokens."""
        if not word:
            return []
        if len(self.rows) > self.most_states:
            self._restart()
            gc.collect()  # rows refer to each other, and full passes wait for the task's end otherwise
        row = self.start
        passed = [row]
        for symbol in word[:-1]:
            try:
                row = row[symbol]
            except KeyError:
                row = self._read(row, symbol)
            passed.append(row)
        token = row[ENDS].get(word[-1])
        if token is None:
            token = self._end(row, word[-1])
        ids, size = [token], self.size
        at = len(word) - size[token]
        while at:
            token = passed[at][LAST]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids

    def decode(self, ids) -> list[str]:
        return [self.label[i] for i in ids]


class WordTokenizer:
    """A tokenizer file of the word-end kind: special strings, normalisation, pre-splitting, automaton.

    Chunks between white space are normalised and pre-split as the library does, by its own tables of characters where they hold more than
    ASCII, since Unicode versions differ. library: split words into ids by the library, too, for operators whose subject isn't the encoding."""

    def __init__(self, path: str, library: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only lower-casing word-end tokenizers without a decoder are supported")
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        loaded = Tokenizer.from_file(path)
        self._normalise, self._pre_split = loaded.normalizer.normalize_str, loaded.pre_tokenizer.pre_tokenize_str
        self._model = loaded.model if library else None
        if not library:
            self.automaton = MergeAutomaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
            self.automaton.label |= {i: t for t, i in self.special.items()}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._latin = {ord(c): self._pre_split(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self._words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def chunk_ids(self, chunk: str | tuple[int]) -> list[int]:
        """Ids of a string without white space, or of a special one (given as a tuple of its id)."""
        if isinstance(chunk, tuple):
            return [*chunk]
        plain = _LATIN.fullmatch(chunk)
        if plain:
            word = plain[1].lower().translate(self._latin)
            return self._word(word) + self._word(plain[2]) if plain[2] else self._word(word)
        if _SIMPLE.fullmatch(chunk):
            return [i for word in self._words.findall(chunk.lower()) for i in self._word(word.translate(self._latin))]
        return [i for word, _ in self._pre_split(self._normalise(chunk)) for i in self._word(word)]

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(word)] if self._model else self.automaton.encode(word)

    def chunks(self, text: str) -> list[str | tuple[int]]:
        """What chunk_ids takes, in order; no merge reaches over a border of chunks."""
        if "<|" in text:
            out: list[str | tuple[int]] = []
            for k, part in enumerate(self._split_special.split(text)):
                out += [(self.special[part],)] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        try:  # lower-casing ahead lets chunks be remembered once; it is exact below U+0100, where nothing composes either
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return _CHUNK.findall(text) if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) else text.split()  # which split takes for space


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text; ids and decoded text come back as counts and SHA-256 digests."""

    def run(batches):
        schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        tok = WordTokenizer(path)

        def known(chunk):
            ids = tok.chunk_ids(chunk)
            return " ".join(map(str, ids)), " ".join(tok.automaton.decode(ids)), len(ids)

        get = Memo(known).__getitem__
        for keys, texts in arrow_rows(batches, id_col, text_col):
            rows = []
            for text in texts:
                parts = [p for p in map(get, tok.chunks(text or "")) if p[2]]
                coded, plain, sizes = zip(*parts) if parts else ((), (), ())
                rows.append((sum(sizes), len(parts), hashlib.sha256(" ".join(coded).encode()).hexdigest(), hashlib.sha256(" ".join(plain).encode()).hexdigest()))
            yield arrow_batch(schema, keys, *(zip(*rows) if rows else [[]] * 4))

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} long, n_tokens long, n_chunks long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: (id, ids array<int>)."""

    def run(batches):
        tok = WordTokenizer(path)
        get = Memo(tok.chunk_ids).__getitem__
        schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])
        for keys, texts in arrow_rows(batches, id_col, text_col):
            yield arrow_batch(schema, keys, [[i for part in map(get, tok.chunks(t or "")) for i in part] for t in texts])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) -> (id, text): the labels of the arcs, joined as the tokenizer file (without a decoder) does; null ids give an empty text."""

    def run(batches):
        tok = WordTokenizer(path)
        schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])
        for keys, ids in arrow_rows(batches, id_col, "ids"):
            yield arrow_batch(schema, keys, [" ".join(tok.automaton.decode(x or [])) for x in ids])

    return rows.select(id_col, "ids").mapInArrow(lean(run), f"{id_col} long, text string")

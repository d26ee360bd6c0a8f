"""BPE encoding as a bounded-lookahead streaming transducer, and incremental
decoding.

Method
------
*Sufficient lookahead.*  ``BpeModel.lookahead`` is computed from the merge list:
the length in symbols of its longest token.  The encoding of a prefix is fixed
by its last token alone and the encoding of what stands before that token, so
whatever follows, the final encoding runs through the end of one of the last
``lookahead`` prefixes.

*Every word* runs through the transducer; what comes of words that fit the window is
remembered (bounded): their ids, as numerals and as the bytes they decode to.  For each prefix end it finds the last
token of that prefix's encoding: the token that ends there and that stands
unchanged beside the last token of the shorter prefix when the two are
encoded together (adjacent tokens of a BPE encoding are exactly those pairs).
Prefix ends older than the lookahead are dropped; tokens are emitted once every
live prefix end goes back through them, so memory is the window and the tokens
not yet agreed on.

*Decoding* is a state machine: ids give bytes, bytes go through an incremental
UTF-8 decoder that holds at most three bytes, text comes out as it is complete.
A file without a decoder joins the token strings with spaces, as its library does.

Texts are read in parts cut at white space, which no token spans.

Defined results: a null or empty text has no tokens and decodes to the empty
text; a special string in a text is its special id, as the library does it; repeated rows
are answered each; a very long text or word takes constant memory; extra columns are
left out.  Letters, numbers and lower cases are those of the tokenizer's own splitter and
normaliser, whatever the interpreter's Unicode version.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowforge.llm.common import tokenizer_path

#: White space of the Unicode property White_Space (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PART_CHARS = 1 << 18
MEMORY = 1 << 19  # remembered words, and token pairs


def byte_symbols() -> list[str]:
    """The printable character of each byte in a byte-level vocabulary: itself
    where it prints, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class BpeModel:
    """Vocabulary and merges, by ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix = suffix
        self.token = {i: t for t, i in vocab.items()}
        self.vocab = vocab
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        # rank and two halves of each token that a merge makes
        self.split = {i: (r, vocab[a], vocab[b]) for r, ((a, b), i) in enumerate(zip(pairs, self.made))}
        self.one_way = len(self.split) == len(self.made)
        self.size = {i: self._symbols(t) for i, t in self.token.items()}
        self.lookahead = max((self.size[i] for i in self.made), default=1)
        self.first = [vocab[s] for s in byte_symbols()]
        self.final = [vocab[s + suffix] for s in byte_symbols()] if suffix else self.first
        self.stand: dict[tuple[int, int], bool] = {}
        self.single: dict[int, bool] = {}
        # tokens that a BPE run can give: those that their own symbols encode to
        self.by_text: dict[tuple[int, ...], int] = {}
        for i in [*self.first, *self.final, *self.made]:
            self.by_text[tuple(self.symbols_of(i))] = i
        # tokens by their symbols from the last one back; -1 holds the token
        self.back: dict = {}
        for symbols, i in self.by_text.items():
            at = self.back
            for x in reversed(symbols):
                at = at.setdefault(x, {})
            at[-1] = i
        self.parts = {i: list(symbols) for symbols, i in self.by_text.items()}

    def _symbols(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def symbols_of(self, i: int) -> list[int]:
        t = self.token[i]
        if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix):
            body = t[:-len(self.suffix)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.suffix]]
        return [self.vocab[c] for c in t]

    def word_symbols(self, word: bytes) -> list[int]:
        out = [self.first[b] for b in word]
        out[-1] = self.final[word[-1]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first, leftmost first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, rank = len(ids), self.rank
        ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1)
                if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank[(a, b)]], -1
            nxt[k] = nxt[j]
            if nxt[k] < n:
                prv[nxt[k]] = k
            for x, y in ((prv[k], k), (k, nxt[k])):
                if x >= 0 and y < n and (r := rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = nxt[k]
        return out

    def alone(self, token: int) -> bool:
        """Whether a token's own symbols encode to it."""
        got = self.single.get(token)
        if got is None:
            got = self.single[token] = self.merge(self.symbols_of(token)) == [token]
        return got

    def _border(self, a: int, b: int) -> bool:
        """The merges of both tokens undone from the last one back, until one over the
        border would have come earlier (leftmost first of one rank) or symbols are left."""
        before, base = len(self.made), (-1, 0, 0)
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            left, right = self.split.get(a, base), self.split.get(b, base)
            if left[0] > right[0]:
                before, a = left[0], left[2]
            elif right[0] >= 0:
                before, b = right[0] + 1, right[1]
            else:
                return True

    def stands(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are side by side: no merge over their border
        comes before those that make the tokens' own parts there."""
        got = self.stand.get((a, b))
        if got is None:
            if len(self.stand) >= MEMORY:
                self.stand.clear()
            got = self.alone(a) and self.alone(b) and self._border(a, b) if self.one_way else \
                self.merge(self.parts[a] + self.parts[b]) == [a, b]
            self.stand[(a, b)] = got
        return got


class Transducer:
    """Streams one long word: ``feed`` its symbols but the last, ``finish`` with
    the last; both yield tokens that can no longer change."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.window: deque[int] = deque(maxlen=model.lookahead)  # last symbols
        self.nodes: deque = deque([(None, None, 0)], maxlen=model.lookahead + 1)  # (before, token, tokens)
        self.emitted = 0  # tokens given out so far

    def _step(self, symbol: int):
        self.window.append(symbol)
        model, nodes, at = self.model, self.nodes, self.model.back
        for size, x in enumerate(reversed(self.window), 1):  # one token at most stands
            at = at.get(x)
            if at is None or size > len(nodes):
                return None
            token = at.get(-1)
            if token is None:
                continue
            before = nodes[-size]
            if before is None:
                continue
            last = before[1]
            if last is None:
                if model.alone(token):
                    return (before, token, before[2] + 1)
                continue
            ok = model.stand.get((last, token))
            if model.stands(last, token) if ok is None else ok:
                return (before, token, before[2] + 1)
        return None

    def feed(self, symbols) -> Iterator[int]:
        for k, s in enumerate(symbols):
            node = self._step(s)
            self.nodes.append(node)
            if (k + 1) % self.model.lookahead == 0:
                yield from self._agreed()

    def _chain(self, node) -> list:
        out = []
        while node is not None and node[1] is not None and node[2] > self.emitted:
            out.append(node)
            node = node[0]
        return out[::-1]

    def _agreed(self) -> Iterator[int]:
        chains = [self._chain(n) for n in self.nodes if n is not None]
        if not chains or not all(chains):
            return
        k = 0
        while all(len(c) > k and c[k] is chains[0][k] for c in chains):
            k += 1
        for node in chains[0][:k]:
            yield node[1]
            self.emitted = node[2]
        if k:
            self._forget(chains[0][k - 1])

    def _forget(self, cut) -> None:
        """Nodes are tuples; rebuild the live ones on top of a bare root."""
        bare = {id(cut): (None, cut[1], cut[2])}

        def again(node):
            path = []
            while id(node) not in bare:
                path.append(node)
                node = node[0]
            made = bare[id(node)]
            for n in reversed(path):
                made = (made, n[1], n[2])
                bare[id(n)] = made
            return made

        self.nodes = deque([None if n is None else again(n) for n in self.nodes],
                           maxlen=self.nodes.maxlen)

    @staticmethod
    def whole(model: BpeModel, symbols: list[int]) -> list[int]:
        """The tokens of a word that fits the window, so that no prefix end of it is
        dropped: the same steps over lists."""
        last: list = [None] * (len(symbols) + 1)  # last token of the prefix that ends here
        size = [0] * (len(symbols) + 1)
        stand, back, last[0] = model.stand.get, model.back, -1
        for end in range(1, len(symbols) + 1):
            at, k = back, end
            while k:
                k -= 1
                at = at.get(symbols[k])
                if at is None:
                    break
                before = last[k]
                if before is None or (token := at.get(-1)) is None:
                    continue
                if k:
                    ok = stand((before, token))
                    ok = model.stands(before, token) if ok is None else ok
                else:
                    ok = model.alone(token)
                if ok:
                    last[end], size[end] = token, end - k
                    break
        out, end = [], len(symbols)
        while end and last[end] is not None:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def finish(self, symbol: int) -> Iterator[int]:
        node = self._step(symbol)
        for n in self._chain(node):
            yield n[1]


#: Code points that have letters, numbers or cases; the planes beyond are unassigned or
#: private, where all libraries agree.
POINTS = [c for c in [*range(0x34000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xE000]


@lru_cache(maxsize=2)
def lower_cases(name: str) -> dict[int, str]:
    """Code points that the tokenizer's normaliser maps otherwise than ``normalize``."""
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(tokenizer_path(name)).normalizer.normalize_str
    return {c: t for c in POINTS if not (x := chr(c)).isspace() and (t := theirs(x)) != StreamEncoder.normalize(x)}


def _ranges(points) -> str:
    """A character class of code points, without its brackets."""
    out, points = [], sorted(points)
    first = last = None
    for p in [*points, None]:
        if first is not None and p == last + 1:
            last = p
            continue
        if first is not None:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
        first = last = p
    return "".join(out)


@lru_cache(maxsize=2)
def word_classes(name: str) -> tuple[frozenset[int], frozenset[int]]:
    """Code points that the tokenizer takes for letters and for numbers, asked of its own
    splitter: a letter joins two letters, a number parts two signs, nothing else does."""
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(tokenizer_path(name)).pre_tokenizer.pre_tokenize_str
    letters, numbers = set(), set()
    for a in range(0, len(POINTS), 1 << 16):
        part = POINTS[a:a + (1 << 16)]
        # two probes each, apart by spaces; every probe has three code points
        whole = {at for _, at in split(" ".join(f"a{chr(c)}a" for c in part))}
        letters |= {c for i, c in enumerate(part) if (4 * i, 4 * i + 3) in whole}
        alone = {at for _, at in split(" ".join(f"!{chr(c)}!" for c in part))}
        numbers |= {c for i, c in enumerate(part) if (4 * i + 1, 4 * i + 2) in alone and c not in letters}
    return frozenset(letters), frozenset(numbers)


class StreamEncoder:
    """Encoder for a tokenizer file with words, byte symbols and word ends."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        import regex
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.model = BpeModel(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.model.token[i] = text
        self.special_re = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        letters, numbers = word_classes(name)
        pattern = r"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^" + SPACE + r"{L}{N}]+"
        self.word_re = regex.compile(pattern.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
        # code points that the two libraries class differently (their Unicode versions differ)
        own = regex.compile(r"(\p{L})|(\p{N})")
        odd = [c for c in POINTS if (1 if c in letters else 2 if c in numbers else None) != ((m := own.match(chr(c))) and m.lastindex)]
        self.cases = lower_cases(name)
        self.odd = frozenset(map(chr, [*odd, *self.cases]))
        self.exact_re = regex.compile(pattern.replace("{L}", _ranges(letters)).replace("{N}", _ranges(numbers)))
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.numeral = {i: str(i).encode() for i in self.model.token}
        self.decoded_table = {i: t.encode("utf-8") for i, t in self.model.token.items()}

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then lower case of each code point by itself."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, text: str) -> Iterator[str]:
        """Stretches of a text cut at ASCII white space."""
        at = 0
        while at < len(text):
            end = at + PART_CHARS
            while end < len(text) and text[end] not in " \n\t\r":
                end += 1
            yield text[at:end]
            at = end

    def words(self, text: str) -> list[str]:
        """Words of a stretch, normalised and split as the tokenizer does it."""
        if text.isascii():
            return self.word_re.findall(self.normalize(text))
        text = unicodedata.normalize("NFC", text)
        if not self.odd.isdisjoint(text):
            return self.exact_re.findall(self.normalize(text.translate(self.cases)))
        return self.word_re.findall(self.normalize(text))

    def word_ids(self, word: str) -> Iterator[int]:
        symbols = self.model.word_symbols(word.encode("utf-8", "surrogatepass"))
        t = Transducer(self.model)
        yield from t.feed(symbols[:-1])
        yield from t.finish(symbols[-1])

    def encode(self, text: str) -> Iterator[int]:
        for kind, x in self._pieces(text):
            if kind == "id":
                yield x
            else:
                yield from self.word_ids(x)

    def _pieces(self, text: str):
        for part in self.parts(text):
            for k, s in enumerate(self.special_re.split(part)):
                if k % 2:
                    yield "id", self.special[s]
                else:
                    for w in self.words(s):
                        yield "word", w

    def _run(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """(tokens, numerals joined by blanks, bytes for the decoder) of some ids."""
        return (len(ids), b" ".join(map(self.numeral.__getitem__, ids)), Decoder.raw(self.decoded_table, b" ", ids))

    def _entry(self, word: str) -> tuple[int, bytes, bytes]:
        """What comes of a word; remembered if it fits the window."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > self.model.lookahead:
            return self._run(list(self.word_ids(word)))
        if len(self.known) >= MEMORY:
            self.known.clear()
        got = self.known[word] = self._run(Transducer.whole(self.model, self.model.word_symbols(raw)))
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, sha256 of the ids, sha256 of the decoded text) as a stream: the ids that
        the transducer emits (remembered for words that stood before) go through the
        decoder as they come, and neither list is held."""
        n, ids_hash, text_hash, known = 0, hashlib.sha256(), hashlib.sha256(), self.known
        decoder = Decoder(self.decoded_table, b" ")
        lead = b""
        for part in self.parts(text):
            for k, s in enumerate(self.special_re.split(part)):
                if k % 2:
                    got = [self._run([self.special[s]])]
                else:
                    words = self.words(s)
                    got = list(map(known.get, words))
                    if None in got:
                        got = [e or self._entry(w) for e, w in zip(got, words)]
                if got:
                    n += sum([e[0] for e in got])
                    ids_hash.update(lead + b" ".join([e[1] for e in got]))
                    text_hash.update(decoder.feed_raw(b" ".join([e[2] for e in got])).encode("utf-8"))
                    lead = b" "
        text_hash.update(decoder.finish().encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@lru_cache(maxsize=2)
def encoder(name: str) -> StreamEncoder:
    """One encoder for all tasks of a Python worker."""
    return StreamEncoder(name)


class Decoder:
    """Ids to text, a little at a time.

    ``table`` gives the bytes of an id and ``between`` what stands between two
    ids; bytes pass an incremental UTF-8 decoder, so a code point that is spread
    over several tokens comes out with its last byte."""

    def __init__(self, table: dict[int, bytes], between: bytes = b""):
        self.table, self.between = table, between
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    @staticmethod
    def raw(table: dict[int, bytes], between: bytes, ids) -> bytes:
        return between.join([table[i] for i in ids])

    def feed(self, ids) -> str:
        return self.feed_raw(self.raw(self.table, self.between, ids)) if len(ids) else ""

    def feed_raw(self, raw: bytes) -> str:
        """Text of the bytes (``raw``) of one id or more."""
        if self.started:
            raw = self.between + raw
        self.started = True
        return self.utf8.decode(raw)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)

    @classmethod
    def joined(cls, encoder: StreamEncoder) -> "Decoder":
        """For files without a decoder: token strings joined with spaces."""
        return cls({i: t.encode("utf-8") for i, t in encoder.model.token.items()}, b" ")

    @classmethod
    def byte_level(cls, encoder: StreamEncoder) -> "Decoder":
        """For texts: symbols back to bytes, word ends to one space."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        special = set(encoder.special.values())
        table = {}
        for i, t in encoder.model.token.items():
            if i in special:
                table[i] = t.encode()
                continue
            end = bool(encoder.model.suffix) and t.endswith(encoder.model.suffix)
            body = t.removesuffix(encoder.model.suffix) if end else t
            table[i] = bytes(back[c] for c in body) + (b" " if end else b"")
        return cls(table)


def encode_documents(docs: DataFrame, text: str = "text", out: str = "input_ids",
                     tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` with the ids of each whole text."""
    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for s in batches:
            yield s.map(lambda t: list(enc.encode(t or "")))

    return docs.withColumn(out, ids(F.col(text)))


def decode_documents(encoded: DataFrame, ids: str = "input_ids", out: str = "decoded",
                     tokenizer: str = "word_bpe_49k.json", joined: bool = True) -> DataFrame:
    """Text of each id list: as the library decodes the file, or as plain text."""
    @pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        table = (Decoder.joined if joined else Decoder.byte_level)(enc)

        def one(seq):
            d = Decoder(table.table, table.between)
            return d.feed(seq if seq is not None else []) + d.finish()

        for s in batches:
            yield s.map(one)

    return encoded.withColumn(out, text(F.col(ids)))


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one
    stream, so that neither the ids nor the decoded text of a document is held."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            got = [enc.digest(t or "") for t in b.column(1).to_pylist()]
            n, i, d = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", doc_id))

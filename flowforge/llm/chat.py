"""Chat formatting with offset-aligned loss masks.

Method
------
Turns of a conversation are rendered in turn order into one string::

    <|im_start|>role<|im_sep|>text<|im_end|>

The string is encoded once, with offsets, by a byte-level tokenizer to which the
three markers are added as special tokens (offsets follow from the byte lengths of
the tokens, ``token_offsets``).  The texts of the assistant form
sorted, disjoint spans of the string; each token span is cut against them by
binary search, which gives the loss mask (a token counts when it overlaps a
turn; the overlap is kept, so the mask is exact to the code point).

Control strings inside roles and texts are escaped reversibly: between ``<`` and
``|`` one more backslash is put than there is, and no marker can be formed by a
text.  ``unescape`` takes one away.

Rows of one conversation stand together by a shuffle on ``conv_id`` and a sort,
and are read as a stream: a conversation longer than ``chunk_chars`` is written
as several numbered rows cut between turns, so no task ever holds one whole (a
marker separates the tokens of two turns, hence the ids are the same).

Defined results: a null text or role counts as empty; turns with equal numbers
stand in the order of role and text; repeated rows are turns of their own; a
null conversation id is one conversation; no rows give no conversations; a very long turn
is a chunk of its own; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import deal_width, shuffle_width, text_bytes, tokenizer_path

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CHUNK_SCHEMA = ("conv_id long, chunk long, n_turns long, formatted string, input_ids array<int>,"
                " loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>")


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted string, and the sorted start and end of each trained text."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == trained and body:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted string."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(START).split(SEP)
        out.append((unescape(role), unescape(text)))
    return out


def cut_spans(tok_start: np.ndarray, tok_end: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(mask, loss start, loss end) per token: its overlap with the sorted,
    disjoint spans, found by binary search.  A token that reaches over several
    spans gets the hull of its overlaps; markers between turns rule that out."""
    if not len(starts):
        zero = np.zeros(len(tok_start), np.int64)
        return np.zeros(len(tok_start), bool), zero, zero
    first = np.searchsorted(ends, tok_start, side="right")  # first span that ends after the token starts
    last = np.searchsorted(starts, tok_end, side="left") - 1  # last span that starts before it ends
    mask = (first <= last) & (tok_end > tok_start)
    f, t = np.minimum(first, len(starts) - 1), np.maximum(last, 0)
    lo = np.where(mask, np.maximum(tok_start, starts[f]), 0)
    hi = np.where(mask, np.minimum(tok_end, ends[t]), 0)
    return mask, lo, hi


def make_tokenizer(tokenizer: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(tokenizer))
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([START, SEP, END])
    return t


def token_bytes(tok) -> np.ndarray:
    """Bytes that each id of a byte-level tokenizer stands for."""
    added = {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
    size = max([tok.get_vocab_size() - 1, *added]) + 1
    return np.fromiter((added.get(i) or len(tok.id_to_token(i) or "") for i in range(size)), np.int64, size)


def token_offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Code point offsets of the tokens of a byte-level encoding, as the tokenizer library
    gives them: a token that holds a part of a code point spans all of it.  None if the
    tokens do not cover the text byte by byte."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum(lengths[ids])
    if not len(ids) or ends[-1] != len(raw):
        return (np.empty(0, np.int64),) * 2 if not len(ids) and not len(raw) else None
    if len(raw) == len(text):  # one byte a code point
        return ends - lengths[ids], ends
    point = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
    return point[ends - lengths[ids]], point[ends - 1] + 1


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", trained: str = "assistant",
                         tokenizer: str = "byte_bpe_50k.json", chunk_chars: int = 1 << 20) -> DataFrame:
    """Rows of ``CHUNK_SCHEMA``; ``loss_starts`` and ``loss_ends`` are code point
    offsets in ``formatted`` of the trained part of each token."""
    def rows(batches) -> Iterator[tuple[int | None, str, str]]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in range(b.num_columns)))

    def chunks(batches):
        """(conv_id, chunk, turns): at most chunk_chars and one turn more."""
        now, chunk, turns, size = None, 0, [], 0
        for cid, r, t in rows(batches):
            if turns and (cid != now or size >= chunk_chars):
                yield now, chunk, turns
                chunk = chunk + 1 if cid == now else 0
                turns, size = [], 0
            elif cid != now:
                chunk = 0
            now = cid
            turns.append((r, t))
            size += len(t)
        if turns:
            yield now, chunk, turns

    def out(held, tok, lengths) -> pa.RecordBatch:
        done = [render(turns, trained) for _, _, turns in held]
        cols: list[list] = [[] for _ in range(8)]
        for (cid, chunk, turns), (s, a, e), enc in zip(
                held, done, tok.encode_batch_fast([d[0] for d in done], add_special_tokens=False)):
            ids = np.array(enc.ids, dtype=np.int32)
            off = token_offsets(s, ids, lengths)
            if off is None:
                off = np.array(tok.encode(s, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2).T
            mask, lo, hi = cut_spans(*off, np.array(a, np.int64), np.array(e, np.int64))
            for c, v in zip(cols, (cid, chunk, len(turns), s, ids, mask, lo.astype(np.int32), hi.astype(np.int32))):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()),
                 pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["conv_id", "chunk", "n_turns", "formatted", "input_ids", "loss_mask", "loss_starts", "loss_ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = make_tokenizer(tokenizer)
        lengths = token_bytes(tok)
        held, size = [], 0
        for c in chunks(batches):
            held.append(c)
            size += sum(len(t) for _, t in c[2])
            if size >= chunk_chars:
                yield out(held, tok, lengths)
                held, size = [], 0
        if held:
            yield out(held, tok, lengths)

    dealt = (conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"),
                                  F.coalesce(F.col(role), F.lit("")).alias("r"),
                                  F.coalesce(F.col(text), F.lit("")).alias("x"))
             .repartition(deal_width(conversations.sparkSession, text_bytes(conversations, text)), "c")
             .sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x"))
    return dealt.mapInArrow(run, CHUNK_SCHEMA)


def loss_parts(formatted: str, mask, starts, ends) -> list[str]:
    """Text under the loss mask, as runs of adjacent code points (the tokens of
    one code point share its offset)."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    a, e = np.asarray(starts)[at], np.maximum.accumulate(np.asarray(ends)[at])
    cut = np.flatnonzero(a[1:] > e[:-1]) + 1
    return [formatted[x:y] for x, y in zip(a[np.r_[0, cut]].tolist(), e[np.r_[cut - 1, len(e) - 1]].tolist()) if y > x]


def conversation_digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, read back from formatted rows: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.  Chunks pass as a stream, and
    only running hashes are kept of a conversation.  ``in_order``: the rows come straight
    from ``format_conversations``, whose tasks hold whole conversations in order, so
    they are read where they are; else they are dealt and sorted."""
    def run(batches):
        now, state = None, None

        def closed():
            n, h, chars, loss, size = state
            return (now, n, h.hexdigest(), chars, loss.hexdigest(), size)

        for b in batches:
            got = []
            def arrays(name):
                col = b.column(name)
                flat, ends = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy() - col.offsets[0].as_py()
                return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

            for cid, s, mask, a, e in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(),
                                          *map(arrays, ("loss_mask", "loss_starts", "loss_ends"))):
                if state is None or cid != now:
                    if state is not None:
                        got.append(closed())
                    now, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(s):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                # unescaped turn by turn: a cut between two texts must not form an escape
                for part in loss_parts(s, mask, a, e):
                    plain = unescape(part)
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(s)
            if got:
                yield _digest_batch(got)
        if state is not None:
            yield _digest_batch([closed()])

    cols = ["conv_id", "chunk", "formatted", "loss_mask", "loss_starts", "loss_ends"]
    rows = formatted.select(cols)
    if not in_order:
        rows = rows.repartition(shuffle_width(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return (rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
                             " loss_sha256 string, formatted_chars long"))


def _digest_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

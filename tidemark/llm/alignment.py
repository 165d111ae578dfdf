"""Alignment of two tokenizers' tokens over the same bytes, by a dangling-suffix transducer.

The state is which side leads and by which bytes; the side that lags gives its next token. Equal bytes close a group,
shorter ones leave a shorter residual, longer ones turn the lead over. Only the leading side's last token can still
dangle, so every token that does not open a group links to exactly that one. Transitions are remembered by state and
next token, and runs by the stretch of text they cover: texts are cut where both tokenizers are bound to start anew.

How often two ids are linked in the whole table is counted from each document's links, and joined back to them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_hot, map_batches, read
from .sentencepiece_bpe import SPACE, Codec, Vocabulary

#: What a worker remembers before it starts anew: stretches of text, and transitions of the transducer.
CACHED_STRETCHES, CACHED_STEPS = 200_000, 1_000_000
TOGETHER = 50  # stretches given to A at once
#: Pairs of ids up to which their counts are sent to every executor; beyond, only the most frequent are.
MOST_BROADCAST = 1_000_000
ROWS_AT_ONCE = 128


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, and the other bytes follow in order from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """States are numbers, 0 being closed; each other one is (A leads, residual bytes)."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.tokens = (b_bytes, a_bytes)  # by whether A is the side that gives
        self.shift = max(len(a_bytes), len(b_bytes)).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.numbers = {self.states[0]: 0}
        self.a_leads = np.zeros(1, bool)
        self.keys, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)  # remembered transitions, by sorted key

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that lags (from closed: of A); -1 where the bytes differ."""
        a_leads, residual = self.states[state]
        piece = self.tokens[not a_leads][token]
        n = min(len(piece), len(residual))
        if piece[:n] != residual[:n]:
            return -1
        left = residual[n:] or piece[n:]
        key = (bool(left) and (a_leads if residual[n:] else not a_leads), left)
        out = self.numbers.setdefault(key, len(self.states))
        if out == len(self.states):
            self.states.append(key)
        return out

    def _steps(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = state << self.shift | token
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = np.unique(key[self.keys[at] != key]) if len(self.keys) else np.unique(key)
        if len(new):
            made = np.array([self._step(k >> self.shift, k & ((1 << self.shift) - 1)) for k in new.tolist()], np.int64)
            places = np.searchsorted(self.keys, new)
            self.keys, self.after = np.insert(self.keys, places, new), np.insert(self.after, places, made)
            self.a_leads = np.array([s[0] for s in self.states], bool)
            at = np.searchsorted(self.keys, key)
        return self.after[at]

    def run(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, set[int]]:
        """Runs many stretches side by side, one token of each a round.

        ``a`` and ``b``: the tokens of all stretches; ``a_ends`` and ``b_ends``: where each stretch's end. Returns which
        tokens of A and of B end a group, the links' stretches, their A ids and B ids, and the stretches that cannot be
        aligned (bytes differ, or one side ends before the other).
        """
        if len(self.keys) > CACHED_STEPS:
            self._forget()
        n = len(a_ends)
        at_a, at_b = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
        close_a, close_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        state, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active, owners, ids_a, ids_b, bad = np.arange(n), [], [], [], set()
        while True:
            done = (state[active] == 0) & (at_a[active] == a_ends[active]) & (at_b[active] == b_ends[active])
            active = active[~done]
            if not len(active):
                break
            now = state[active]
            from_a = ~self.a_leads[now]  # a closed state does not count as led by A
            over = np.where(from_a, at_a[active] == a_ends[active], at_b[active] == b_ends[active])
            if over.any():
                bad.update(active[over].tolist())
                active, now, from_a = active[~over], now[~over], from_a[~over]
                if not len(active):
                    break
            token = np.empty(len(active), np.int64)
            token[from_a], token[~from_a] = a[at_a[active[from_a]]], b[at_b[active[~from_a]]]
            at_a[active[from_a]] += 1
            at_b[active[~from_a]] += 1
            linked = now != 0
            before = last[active]
            owners.append(active[linked])
            ids_a.append(np.where(from_a, token, before)[linked])
            ids_b.append(np.where(from_a, before, token)[linked])
            after = self._steps(now, token)
            closed = active[after == 0]
            close_a[at_a[closed] - 1] = close_b[at_b[closed] - 1] = True
            # the new token leads if it opened the group or is longer than what was left
            leads = (now == 0) | (self.a_leads[after] == from_a)
            last[active] = np.where(leads, token, before)
            state[active] = after
            if (after < 0).any():
                bad.update(active[after < 0].tolist())
                active = active[after >= 0]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return close_a, close_b, join(owners), join(ids_a), join(ids_b), bad


def _starts_anew(stretch: str) -> bool:
    """Whether A reads a stretch alike after any other of these."""
    return stretch[0] == " " and not stretch[-1].isspace() and not stretch[1].isspace()


@dataclass
class Pair:
    """Both tokenizers as tasks get them: A's file as text, B's vocabulary."""

    a_json: str
    b: Vocabulary

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        with open(a_path, encoding="utf-8") as f:
            return cls(f.read(), Vocabulary.load(b_path))


class Aligner:
    """Aligns texts in a task; what it remembers is bounded."""

    def __init__(self, pair: Pair):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(pair.a_json)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = Codec(pair.b)
        chars = byte_level()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(chars[c] for c in self.a.id_to_token(i)) if all(c in chars for c in self.a.id_to_token(i)) else b"" for i in range(size)]
        v = pair.b
        self.b_bytes = [p.replace(SPACE, " ").encode() if v.mergeable[i] else b"" for i, p in enumerate(v.pieces)]
        for byte, i in enumerate(v.byte_ids):
            self.b_bytes[i] = bytes([byte])
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        #: each id in decimal with each of the marks that can follow it, by mark * size + id
        self._shown = [f"{i}{mark}" for mark in ",|;\n" for i in range(max(size, len(v.pieces)))]
        # Both start anew at a single space before something else, and around a lone line end if no piece of B joins it.
        self._lone_ends = not any("\n" in p and len(p) > 1 for i, p in enumerate(v.pieces) if v.mergeable[i])
        lone = "|(?<=\\S)(?=\n)|(?<=\\S\n)(?=\\S)" if self._lone_ends else ""
        self._cuts = re.compile(f"(?<! )(?= \\S){lone}")
        self._other_space = re.compile("[^\\S \n]")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.ends, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each stretch in ``links``; A's id * B's size + B's id
        self.bad: np.ndarray = np.zeros(0, bool)
        self.used: np.ndarray = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forgets all but the two thirds of CACHED_STRETCHES that were used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHED_STRETCHES * 2 // 3])
        places, _ = self._links_of(keep)
        names = list(self.known)  # in order of their numbers
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.links, self.sizes, self.bad, self.used = self.links[places], self.sizes[keep], self.bad[keep], self.used[keep] // 2
        self.ends = np.cumsum(self.sizes[:, 3])

    def _links_of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``links`` of the links of ``stretches``, one after the other, and how many each has."""
        lengths = self.sizes[stretches, 3]
        total = np.cumsum(lengths)
        return np.repeat(self.ends[stretches] - total, lengths) + np.arange(total[-1] if len(total) else 0), lengths

    def cut(self, text: str) -> list[str]:
        """The stretches of a space and ``text``."""
        text = " " + text
        if self._lone_ends and not self._other_space.search(text):
            parts = text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")[1:]
            if "" not in parts and " " not in parts:  # only single spaces and lone line ends
                return parts
        return [s for s in self._cuts.split(text) if s]

    def _encode_a(self, stretches: list[str], true: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches and where each one's end. The first of them, see ``_learn``, are encoded many at a
        time, as A starts anew at each; their ends are then found by their bytes."""
        many = next((i for i, s in enumerate(stretches) if not _starts_anew(s)), len(stretches))
        joined = ["".join(stretches[i : min(i + TOGETHER, many)]) for i in range(0, many, TOGETHER)] + stretches[many:]
        ids = self._flat(joined)
        at = np.cumsum(self.a_sizes[ids])
        ends = np.cumsum([len(x) for x in true])
        found = np.searchsorted(at, ends, side="right")
        if (found > 0).all() and (at[found - 1] == ends).all():
            return ids, found
        each = [self._flat([s]) for s in stretches]  # a tokenizer that does not keep the bytes
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _flat(self, texts: list[str]) -> np.ndarray:
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))

    def _learn(self, stretches: list[str]) -> None:
        m = len(stretches)
        stretches.sort(key=_starts_anew, reverse=True)
        true = [s.encode("utf-8", "surrogatepass") for s in stretches]
        a, a_ends = self._encode_a(stretches, true)
        n_a = np.diff(a_ends, prepend=0)
        split = [[s.replace(" ", SPACE)] if " " not in s[1:] and "\n" not in s else self.b._words(s.replace(" ", SPACE)) for s in stretches]
        pieces = self.b._merge_words(list(chain.from_iterable(split)))
        b = np.frombuffer(b"".join(pieces), np.int32).astype(np.int64)
        of_word = np.cumsum([len(x) // 4 for x in pieces])
        b_ends = of_word[np.cumsum([len(ws) for ws in split]) - 1]
        n_b = np.diff(b_ends, prepend=0)
        bad = self._differing(true, a, a_ends)
        close_a, close_b, owners, ids_a, ids_b, failed = self.transducer.run(a, a_ends, b, b_ends)
        bad[list(failed)] = True
        groups = np.add.reduceat(close_a.astype(np.int64), a_ends - n_a)
        if bad.any():  # these would put the others' groups out of step, so each goes alone
            texts = [self._text(*(x[e - k : e] for x, e, k in ((a, ea, na), (close_a, ea, na), (b, eb, nb), (close_b, eb, nb)))) for ea, na, eb, nb in zip(a_ends, n_a, b_ends, n_b)]
        else:  # A's tokens of a group come before B's; a group's number counts over all stretches
            group_a, group_b = (np.cumsum(c) - c for c in (close_a, close_b))
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            last = 2 * close_b.astype(np.int64)
            last[b_ends - 1] = 3
            shown = np.concatenate([close_a, last]) * (len(self._shown) // 4) + np.concatenate([a, b])
            texts = "".join(map(self._shown.__getitem__, shown[order].tolist())).split("\n")[:-1]
        order = np.argsort(owners, kind="stable")
        self.known.update(zip(stretches, range(len(self.groups), len(self.groups) + m)))
        self.groups += texts
        self.links = np.concatenate([self.links, (ids_a * len(self.b_bytes) + ids_b)[order]])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, np.bincount(owners, minlength=m)], axis=1)])
        self.ends = np.cumsum(self.sizes[:, 3])
        self.bad, self.used = np.append(self.bad, bad), np.append(self.used, np.zeros(m, np.int64))

    def _differing(self, true: list[bytes], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which stretches A does not give back byte by byte; where A does, the transducer finds B's differences."""
        parts = list(map(self.a_bytes.__getitem__, ids.tolist()))
        if b"".join(parts) == b"".join(true):
            return np.zeros(len(true), bool)  # A's ends are those of the stretches' bytes
        return np.array([b"".join(parts[x:y]) != t for x, y, t in zip([0, *ends.tolist()], ends.tolist(), true)])

    def _text(self, a: np.ndarray, close_a: np.ndarray, b: np.ndarray, close_b: np.ndarray) -> str:
        ends = [np.flatnonzero(c) + 1 for c in (close_a, close_b)]
        parts = [[",".join(map(str, part.tolist())) for part in np.split(ids, e)] for ids, e in zip((a, b), ends)]
        return ";".join(f"{x}|{y}" for x, y in zip(*parts) if x and y)

    def align(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The groups of each text as text ('' without tokens), (n_a, n_b, n_groups, n_links) of each, and its distinct
        linked pairs: which text, the pair as a << 32 | b, and how often the text links it."""
        split = [self.cut(t) if t and SPACE not in t else [] for t in texts]
        lengths = np.array([len(ss) for ss in split])
        every = list(chain.from_iterable(split))
        new = list({s for s in every if s not in self.known})
        if len(self.known) + len(new) > CACHED_STRETCHES and self.known:
            self._shrink()
            new = list({s for s in every if s not in self.known})
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        text = np.repeat(np.arange(len(texts)), lengths)
        without = np.bincount(text, self.bad[at], len(texts)) > 0
        ends = np.cumsum(lengths)
        name = self.groups.__getitem__
        groups = ["" if w else ";".join(map(name, at[e - k : e].tolist())) for w, e, k in zip(without.tolist(), ends.tolist(), lengths.tolist())]
        stay = ~without[text]
        size = max(len(self.groups), 1)
        both, times = np.unique(text[stay] * size + at[stay], return_counts=True)
        text, each = both // size, both % size
        np.add.at(self.used, each, times)
        sizes = np.zeros((len(texts), 4), np.int64)
        for c in range(4):
            sizes[:, c] = np.bincount(text, self.sizes[each, c] * times, len(texts)).astype(np.int64)
        places, n_links = self._links_of(each)
        codes = len(self.a_bytes) * len(self.b_bytes)
        key, weight = np.repeat(text, n_links) * codes + self.links[places], np.repeat(times, n_links)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        summed = np.add.reduceat(weight[order], first) if len(key) else np.zeros(0, np.int64)
        text, code = key[first] // codes, key[first] % codes
        return groups, sizes, text, code // len(self.b_bytes) << 32 | code % len(self.b_bytes), summed


_aligners: dict[int, Aligner] = {}


def _aligner(pair: Pair, key: int) -> Aligner:
    """One a worker, kept over tasks."""
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(pair)
    return _aligners[key]


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",), with_groups: bool = False) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups_sha256 and links array<struct<pair, times>>, one row a row.

    ``a_path``: a byte-level BPE file (A reads a space and the text); ``b_path``: a sentencepiece BPE model (B adds the
    space itself). ``pair`` is A's id << 32 | B's id, ``times`` how many of the document's links hold it. ``with_groups``
    adds the groups themselves as text, a1,a2|b1;a3|b2,b3.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, no links
    and an empty digest. Texts are aligned whole; repeated rows stay rows of their own; ``keep`` may not be named like
    a result. Empty tables give no rows.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    pair = docs.sparkSession.sparkContext.broadcast(Pair.load(a_path, b_path))  # two vocabularies
    key = hash((pair.value.a_json, tuple(pair.value.b.pieces), tuple(pair.value.b.scores)))
    kept = docs.select(*keep).schema.fields
    made = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair: bigint, times: int>>" + ", groups string" * with_groups
    schema = T.StructType([*kept, *T.StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches):
        aligner = _aligner(pair.value, key)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                groups, sizes, of_text, pair_ids, times = aligner.align(part.column(n).to_pylist())
                ends = np.searchsorted(of_text, np.arange(part.num_rows + 1)).astype(np.int32)
                kind = arrow.field("links").type
                columns_of = [pa.array(pair_ids), pa.array(times.astype(np.int32))]
                links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns_of, fields=list(kind.value_type)), type=kind)
                shown = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [*(pa.array(sizes[:, i]) for i in range(4)), pa.array(shown), links]
                columns += [pa.array(groups)] * with_groups
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    return map_batches(source, run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best, rows_of_key): how many links of the whole table hold each pair of ids, whether that is the
    most of its B id (ties included), and how many rows have it."""
    links = aligned.select(F.inline("links"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows_of_key"))
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # at most as many rows as A has ids
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"), "rows_of_key")


def link_agreement(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row a row of ``docs``.

    ``n_best``: links whose pair is linked as often as any of its B id in the whole table; ``count_sum``: those counts
    over all links. See :func:`align_documents` for nulls, long texts, repeated rows and empty tables. Counts of up to
    MOST_BROADCAST pairs go to every executor; of more, those of the most frequent do and the rest are joined by a
    shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    aligned = align_documents(docs, a_path, b_path, keep)
    aligned = scratch.save(aligned.withColumn("_row", F.monotonically_increasing_id()))
    pairs = scratch.save(pair_counts(aligned))
    known, total = pairs.agg(F.count("*"), F.coalesce(F.sum("rows_of_key"), F.lit(0))).first()
    links = aligned.select("_row", F.inline("links"))
    if known <= MOST_BROADCAST:
        counted = links.join(F.broadcast(pairs.drop("rows_of_key")), "pair")
    else:
        counted = join_hot(links, pairs, "pair", total)
    sums = counted.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return aligned.drop("links").join(sums, "_row", "left").select(*keep, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return link_agreement(read(spark, sf_dir, "documents"), a, b)

"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A batch's distinct words lie in one flat numpy array of symbols. Each round looks up the rank of every adjacent pair,
takes the segmented minimum per word, merges all leftmost non-overlapping occurrences of it at once and compacts the
array, until no word has a pair left. No piece holds a space mark after another character, so words are independent.

A round may merge several pairs of a word only if no pair that a merge creates ranks as well as the one merged;
otherwise it merges the leftmost alone. That makes the outcome the same as one merge at a time in (rank, position) order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read

SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
CACHED_WORDS = 300_000  # words whose ids a worker remembers


@dataclass
class Vocabulary:
    """What the model file says; small (one entry per piece), so tasks get it with their code."""

    pieces: list[str]
    scores: list[float]
    mergeable: list[bool]
    byte_ids: list[int]  # id of each byte's piece
    unknown: int
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [i not in special for i in ids], byte_ids, sp.unk_id(), sp.bos_id(), sp.eos_id())


@dataclass
class Codec:
    vocabulary: Vocabulary
    _cache: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        known = {p: i for i, p in enumerate(v.pieces) if v.mergeable[i]}
        inner = sorted({c for p in known if len(p) > 1 for c in p} - known.keys())
        #: Characters that only occur inside pieces get numbers after the pieces; they end as bytes if nothing merges them.
        symbols = known | {c: len(v.pieces) + k for k, c in enumerate(inner)}
        self._outside = inner
        self._symbol = np.full(0x110000, -1, np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self._symbol[ord(p)] = i
        rank = {s: k for k, s in enumerate(sorted({v.scores[i] for i in known.values()}, reverse=True))}
        pairs = [(symbols[p[:k]], symbols[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self._table(np.array([a << 32 | b for a, b, _ in pairs], np.int64), np.array([i for _, _, i in pairs], np.int64), np.array([rank[v.scores[i]] for _, _, i in pairs], np.int32))
        joins = {c for p in known if len(p) > 1 for c in p}
        #: A line end that no piece joins is a word of its own, which lets the words around it be remembered.
        self._words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if "\n" not in joins else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._bytes = [p.replace(SPACE, " ").encode() if v.mergeable[i] else b"" for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            self._bytes[i] = bytes([b])
        self._bytes[v.unknown] = " ⁇ ".encode()
        self._is_byte = set(v.byte_ids)
        self._controls = {i for i in range(len(v.pieces)) if not v.mergeable[i]} - self._is_byte - {v.unknown}

    def _table(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probes: a lookup is one gather for nearly every pair."""
        self._slots = 1 << (int(len(keys) * 4).bit_length())
        self._keys = np.full(self._slots, -1, np.int64)
        self._merged, self._ranks = np.zeros(self._slots, np.int64), np.full(self._slots, NO_PAIR, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self._keys[slot[left]] == -1
            at, first = np.unique(slot[left[free]], return_index=True)
            own = left[free][first]
            self._keys[at], self._merged[at], self._ranks[at] = keys[own], merged[own], ranks[own]
            left = np.setdiff1d(left, own)
            taken = self._keys[slot[left]] != keys[left]
            slot[left] = np.where(taken, (slot[left] + 1) % self._slots, slot[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self._slots.bit_length())).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NO_PAIR where there is none."""
        key = left << 32 | (right & 0xFFFFFFFF)
        slot = self._slot(key)
        found = self._keys[slot]
        odd = np.flatnonzero((found != key) & (found != -1))
        while len(odd):
            slot[odd] = (slot[odd] + 1) % self._slots
            found[odd] = self._keys[slot[odd]]
            odd = odd[(found[odd] != key[odd]) & (found[odd] != -1)]
        return np.where((found == key) & (left >= 0), self._ranks[slot], NO_PAIR), self._merged[slot]

    def _merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as int32 bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self._symbol[points]
        unknown = symbol < 0
        symbol[unknown] = -2 - points[unknown].astype(np.int64)  # unknown characters keep their code point
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        #: rank and merged symbol of the pair that starts at each place, kept over the rounds
        rank, merged = self._pairs(symbol, np.append(symbol[1:], -1))
        rank[np.append(word[1:] != word[:-1], True)] = NO_PAIR
        done_symbols, done_words = [], []
        while True:
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == NO_PAIR
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                stay = ~over
                symbol, word, rank, best, merged = symbol[stay], word[stay], rank[stay], best[stay], merged[stay]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            # of a run of overlapping pairs, every second one from its left end
            first = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            new = merged[at]
            # pairs that a merge creates, with what has been merged to its left by then and with what still stands to its right
            before = symbol[at - 1]
            chained = np.append(False, (np.diff(at) == 2))
            before[chained] = new[:-1][chained[1:]]
            left = np.where((at > 0) & (word[at - 1] == word[at]), self._pairs(before, new)[0], NO_PAIR)
            after = np.minimum(at + 2, len(word) - 1)
            right = np.where((at + 2 < len(word)) & (word[after] == word[at]), self._pairs(new, symbol[after])[0], NO_PAIR)
            risky = np.minimum(left, right) <= best[at]
            if risky.any():
                alone = np.isin(word[at], word[at[risky]])
                leading = np.append(True, word[at[1:]] != word[at[:-1]])
                at, new = at[~alone | leading], new[~alone | leading]
            symbol[at] = new
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, word, rank, merged = symbol[stay], word[stay], rank[stay], merged[stay]
            at = at - np.arange(len(at))  # each merge before moves it by one
            changed = np.concatenate([at, at[at > 0] - 1])
            following = np.minimum(changed + 1, len(symbol) - 1)
            own, rank_now = self._pairs(symbol[changed], symbol[following])[::-1]
            rank[changed] = np.where((word[following] == word[changed]) & (following > changed), rank_now, NO_PAIR)
            merged[changed] = own
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        ends = np.searchsorted(word, np.arange(len(words)), side="right").tolist()
        packed = symbol.astype(np.int32).tobytes()
        out = [packed[a * 4 : b * 4] for a, b in zip([0, *ends], ends)]
        for w in np.unique(word[(symbol < 0) | (symbol >= len(self.vocabulary.pieces))]).tolist():
            out[w] = self._with_bytes(symbol[ends[w - 1] if w else 0 : ends[w]])
        return out

    def _with_bytes(self, symbols: np.ndarray) -> bytes:
        size, out = len(self.vocabulary.pieces), []
        for s in symbols.tolist():
            if 0 <= s < size:
                out.append(s)
            else:
                char = self._outside[s - size] if s >= 0 else chr(-2 - s)
                out += [self.vocabulary.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str | None], begin: bool = False, end: bool = True) -> list[np.ndarray]:
        """int32 ids of each text; null counts as empty."""
        split = [self._words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self._cache})
        if len(self._cache) + len(new) > CACHED_WORDS:
            self._cache.clear()
            new = list({w for ws in split for w in ws})
        if new:
            self._cache.update(zip(new, self._merge_words(new)))
        v, get = self.vocabulary, self._cache.__getitem__
        head = np.array([v.begin] * begin, np.int32).tobytes()
        tail = np.array([v.end] * end, np.int32).tobytes()
        return [np.frombuffer(head + b"".join(map(get, ws)) + tail, np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids vanish, byte pieces join to characters, the first space mark goes."""
        ids = np.asarray(ids).tolist()
        lead = next((i for i in ids if i not in self._controls), None)
        if self._controls.isdisjoint(ids[1:-1]):
            try:
                text = b"".join(map(self._bytes.__getitem__, ids)).decode()
            except UnicodeDecodeError:
                text = self._decode_loose(ids)
        else:  # a control id parts the bytes on its sides
            text = self._decode_loose(ids)
        return text[1:] if lead is not None and self.vocabulary.pieces[lead].startswith(SPACE) else text

    def _decode_loose(self, ids: list[int]) -> str:
        """Each byte that is part of no character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids, self.vocabulary.end]:
            if i in self._is_byte:
                run += self._bytes[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            out.append(self._bytes[i].decode())
        return "".join(out)


_codecs: dict[int, Codec] = {}


def _codec(vocabulary: Vocabulary, key: int) -> Codec:
    """One codec a worker, kept over tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), begin: bool = False, end: bool = True) -> DataFrame:
    """``keep`` columns, ids array<int> of the whole text and decoded string, the text of those ids.

    Null and empty texts have only the begin and end ids asked for and decode to the empty string. Repeated rows
    stay, empty tables give none, other columns are dropped. The model file is read where the driver runs.
    """
    vocabulary = Vocabulary.load(model_path)
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))

    def make():
        codec = _codec(vocabulary, key)

        def run(texts):
            ids = codec.encode(texts, begin, end)
            return ids, [codec.decode(x) for x in ids]

        return run

    return map_rows(docs, keep, ("text",), make, "ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and decoded string, the text of the column ids; null ids: null."""
    vocabulary = Vocabulary.load(model_path)
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))

    def make():
        codec = _codec(vocabulary, key)
        return lambda ids: [[None if x is None else codec.decode(x) for x in ids]]

    return map_rows(encoded, keep, ("ids",), make, "decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
        }
    ).drop("ids", "decoded")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))

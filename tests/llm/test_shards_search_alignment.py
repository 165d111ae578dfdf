"""Operators 11 to 13: against brute force, libraries and SQL (see test_llm.py), on odd tables, and spread keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, lexical_search, sharding
from tidemark.plans.ship import ship

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \t\n", "a", "one two", "x" * 50_000, "word " * 20_000, "ÄÖ ß\u00a0日本 🙂\u0300", "a\x0bb\x1cc\x85d", "a b c", "a b c", "A b C", "a▁b", "<|endoftext|> </s>", "x  y   z \n\n w\n"]


def docs_of(spark, texts, clashing=True):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    names = "size shard slot law copies range cell place score rank term links pair _row _text n_a name fraction".split() if clashing else []
    return df.withColumns({n: F.lit(7) for n in names})


def odd_docs(spark):
    """Odd texts, a repeated row, an id with two texts, null ids, and columns named like results and internals."""
    df = docs_of(spark, ODD)
    null_id = df.where("doc_id in (3, 9)").withColumn("doc_id", F.lit(None).cast("bigint"))
    return df.unionByName(df.where("doc_id = 9")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(9).cast("bigint"))).unionByName(null_id)


# 11: sharding


def plain_shards(rows, shards):
    """(doc_id, crc, shard, slot) of (doc_id, text, source), by one sorted list."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    keyed = []
    for i, text, source in rows:
        crc = zlib.crc32((text or "").encode())
        name = "n" if source is None else "s" + source
        keyed.append((name, md5(f"shard-1:{'null' if i is None else i}:{crc}"), -1 if i is None else i, len((text or "").encode()), crc))
    per, placed = {}, []
    for row in sorted(keyed):
        per.setdefault(row[0], []).append(row)
    for name, own in per.items():
        u = int(md5("shard-1:" + name)[:8], 16) / 2**32
        placed += [((r + u) / len(own), *row) for r, row in enumerate(own)]
    out, seen = [], Counter()
    for p, (_, _, _, i, _, crc) in enumerate(sorted(placed)):
        shard = (2 * p + 1) * shards // (2 * len(placed))
        out.append((i, crc, shard, seen[shard]))
        seen[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_against_one_sorted_list(spark, shards):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, shards).collect()]
    assert sorted(got) == plain_shards(rows, shards)


@pytest.mark.parametrize("law", sharding.LAWS)
def test_every_shard_matches_the_mixture(spark, law):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(1, 60), "en", rng.choices([None, "a", "b", "c"], [1, 9, 5, 2])[0], 0) for i in range(6_000)]
    rows += [(i, "z", "en", f"lone{i}", 0) for i in range(10_000, 10_400)]  # sources of one row
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(docs, 8, law).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    weight = "size" if law == "bytes" else "one"
    got["one"] = 1
    per = got.groupby("shard")[weight].sum()
    assert len(per) == 8 and per.max() - per.min() <= (1 if law == "rows" else 2 * got["size"].max())
    for shard, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
        assert 30 <= part["source"].fillna("").str.startswith("lone").sum() <= 75
        for source in ("a", "b", "c"):
            want = got[got["source"] == source][weight].sum() / 8
            assert abs(part[part["source"] == source][weight].sum() - want) <= (1 if law == "rows" else got["size"].max()) + 0.03 * want, (shard, source)


def test_copies_of_one_row_are_counted_and_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES_AT_ONCE", 7)
    docs = spark.range(300).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(100, 200).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"), F.lit("t").alias("source")))
    got = sharding.shard_documents(docs, 4).toPandas()
    assert got["shard"].value_counts().to_dict() == {0: 100, 1: 100, 2: 100, 3: 100}
    assert got[got["doc_id"] == 5]["shard"].value_counts().to_dict() == {0: 75, 1: 75, 2: 75, 3: 75}
    assert len(got[["shard", "slot"]].drop_duplicates()) == 400


def test_shards_are_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (sharding.shard_documents(d, 7, "bytes") for d in (docs, docs.repartition(9)))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    docs = odd_docs(spark)
    manifest = sharding.write_shards(docs, f"{tmp_path}/out", 3, keep=("lang",)).orderBy("shard").collect()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "source", "lang").collect())) == sorted(map(str, docs.select("doc_id", "text", "source", "lang").collect()))
    assert [r["rows"] for r in manifest] == [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()]
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 3, "key")
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


# 12: ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        wanted = {t for i, text in items if i == item for t in terms_of(text)}
        scores = []
        for doc, c in counted:
            m = 10 + 90 * c.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted & c.keys())
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_against_every_document(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(lexical_search, "POSTINGS_PER_SHARD", 60)  # many shards, ties across them
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d É e1 F_g h-i 日本").split(" ") and rng.choice("a b c d É e1 f g h 日本".split()) for _ in range(rng.randrange(9))) for _ in range(400)]
    docs = docs_of(spark, texts).unionByName(odd_docs(spark))
    items = [(1, "A b, zzz"), (2, "É!"), (3, None), (4, ""), (5, "nowhere"), (1, "h"), (None, "c c c"), (7, "word x")]
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("score", F.lit(1))
    index = lexical_search.build_index(docs)
    assert index.shards.count() > 5
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items)
    assert found(lexical_search.search(index, table)) == want
    monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 3)  # several blocks of items
    assert found(lexical_search.search(index, table)) == want
    few = plain_search([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items, 2)
    assert found(lexical_search.search(index, table, 2)) == few
    assert dict(index.document_frequencies().collect())["a"] == sum("a" in terms_of(r["text"]) for r in docs.select("text").collect())


def test_search_of_empty_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([(1, "one")], "item_id int, text string")
    assert lexical_search.search(lexical_search.build_index(docs.limit(0)), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs.where("text is null")), items).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ab c_d é9 " * 500
    whole = lexical_search.count_terms(text.encode())
    monkeypatch.setattr(lexical_search, "_TEXT_AT_ONCE", 13)
    assert lexical_search.count_terms(text.encode()) == whole == Counter({k: v for k, v in ((t.encode(), n) for t, n in Counter(terms_of(text)).items())})


def test_impacts_beyond_64_bits():
    import numpy as np

    lengths = np.array([10**9, 5], np.int64)
    got = lexical_search.impacts(np.array([3, 1]), lengths, 10**12, 10**13)
    want = [10**9 * c // (1000 * c + 8 * (10 + 90 * n * 10**12 // 10**13)) for c, n in ((3, 10**9), (1, 5))]
    assert got.tolist() == want


# 13: alignment of tokenizers


def plain_alignment(texts):
    """Per text (n_a, n_b, groups, links) by whole-text encodings, byte offsets and all pairs of a group."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    chars = alignment.byte_level()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            out.append(None)
            continue
        ranges = []
        for ids, parts in ((ia, ba), (ib, bb)):
            at, spans = 0, []
            for i, p in zip(ids, parts):
                spans.append((i, at, at + len(p)))
                at += len(p)
            ranges.append(spans)
        ends = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, links, x, y = [], [], 0, 0
        for e in ends:
            ga, gb = [], []
            while x < len(ia) and ranges[0][x][2] <= e:
                ga.append(ranges[0][x])
                x += 1
            while y < len(ib) and ranges[1][y][2] <= e:
                gb.append(ranges[1][y])
                y += 1
            groups.append(",".join(str(g[0]) for g in ga) + "|" + ",".join(str(g[0]) for g in gb))
            links += [(p[0], q[0]) for p in ga for q in gb if p[1] < q[2] and q[1] < p[2]]
        out.append((len(ia), len(ib), groups, links))
    return out


def check_alignment(rows, texts):
    plain = plain_alignment(texts)
    counts = Counter(p for x in plain if x for p in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for row, text, x in zip(rows, texts, plain):
        got = (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["n_best"], row["count_sum"], row["groups_sha256"])
        if x is None:
            assert got == (0, 0, 0, 0, 0, 0, ""), text
        else:
            best = sum(counts[p] == most[p[1]] for p in x[3])
            want = (x[0], x[1], len(x[2]), len(x[3]), best, sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest())
            assert got == want, text


def test_alignment_against_whole_texts_and_offsets(spark):
    ship(spark)
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "é", "日本", "\n", "\t", "'s", "<|endoftext|>", "🙂", "\u00a0", "\u3000", "...", "12", "_", "\r\n", "\x1c", "▁", "ing", " the", "ﬁ", "\u0300", "\ufeff"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    rows = alignment.link_agreement(docs_of(spark, texts), A_PATH, B_PATH).orderBy("doc_id").collect()
    check_alignment(rows, texts)


def test_alignment_with_counts_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_BROADCAST", 10)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()] + ODD
    check_alignment(alignment.link_agreement(docs_of(spark, texts), A_PATH, B_PATH).orderBy("doc_id").collect(), texts)


def test_a_worker_that_forgets_aligns_alike(monkeypatch):
    aligner = alignment.Aligner(alignment.Pair.load(A_PATH, B_PATH))
    texts = [" ".join(random.Random(i).sample("the quick brown foxes jumped over lazily sleeping dogs".split(), 5)) for i in range(50)]
    want = aligner.align(texts)[0]
    monkeypatch.setattr(alignment, "CACHED_STRETCHES", 3)
    monkeypatch.setattr(alignment, "CACHED_STEPS", 2)
    aligner = alignment.Aligner(alignment.Pair.load(A_PATH, B_PATH))
    assert [aligner.align([t])[0][0] for t in texts] == want
    assert len(aligner.known) <= 8


def test_alignment_keeps_odd_rows_and_groups(spark):
    docs = odd_docs(spark)
    out = alignment.link_agreement(docs, A_PATH, B_PATH, ("doc_id", "lang"))
    assert out.count() == docs.count() and out.where("doc_id is null").count() == 2
    assert alignment.link_agreement(docs.limit(0), A_PATH, B_PATH).count() == 0
    with_groups = alignment.align_documents(docs, A_PATH, B_PATH, with_groups=True).where("doc_id = 4").first()
    assert with_groups["groups"].count("|") == with_groups["n_groups"] > 0
    assert hashlib.sha256(with_groups["groups"].encode()).hexdigest() == with_groups["groups_sha256"]

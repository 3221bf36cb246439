"""The numbered operators against brute-force versions, round trips, held-out accuracy and edge cases."""

import hashlib
import io
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import chat, decontaminate, html_text, katz, media, mixing, near_dup, queries, token_counts, toxicity, warc
from caseflow.llm.common import tokenizer_path
from caseflow.llm.html_pages import fill

from ..compare import duck, rows
from . import pages

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def docs(spark, texts, extra=True):
    """Documents with nulls, repeated rows and a clashing extra column."""
    rows_ = [(k, t, "en", f"src{k % 3}" if k % 7 else None, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, score int")
    return df if extra else df.drop("score")


def random_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    for k in range(0, n // 3):
        w = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w).title() if k % 5 == 0 else "\t".join(w))
    return [*texts, "", None, "  \n ", "one", "one two three", "one two three", texts[0], texts[0], "é ß 日本 " * 40, "x" * 50_000]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck(SF).execute(queries.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_give_a_row_for_each_input(spark, name):
    n = spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
    assert queries.queries()[name](spark, SF).count() == n


# 1


def brute_katz(data):
    u, b = Counter(), Counter()
    tokens = {k: [*words(t), None] for k, t in data.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in data}
    for k, w in tokens.items():
        if not held[k]:
            u.update(w), b.update(zip(w, w[1:]))
    n, v = sum(u.values()), len(u)
    d1, d2 = (katz.discounts(Counter(c.values()), least) for c, least in ((u, 1), (b, katz.MIN_PAIR)))
    p = {w: d1.get(c, 1) * c / n for w, c in u.items()}
    unseen = 1 - sum(p.values())
    mass, low = defaultdict(float), defaultdict(float)
    for (x, y), c in b.items():
        if c >= katz.MIN_PAIR:
            mass[x] += d2.get(c, 1) * c / u[x]
            low[x] += p[y]

    def given(x, y):
        c, spare = b.get((x, y), 0), max(1 - mass[x], 1 / (u[x] + 1))
        if c >= katz.MIN_PAIR:
            return (1 - spare) / mass[x] * d2.get(c, 1) * c / u[x]
        return (spare / max(1 - low[x], unseen) if x in mass and mass[x] else 1.0) * p.get(y, unseen)

    for x in list(u)[:20]:
        if x is not None:
            spare = max(1 - mass[x], 1 / (u[x] + 1))
            rest = (spare / max(1 - low[x], unseen) if mass[x] else 1.0) * unseen
            assert sum(given(x, y) for y in u) + rest == pytest.approx(1)
    out = {}
    for k, w in tokens.items():
        s = math.log10(p.get(w[0], unseen)) + sum(math.log10(given(x, y)) for x, y in zip(w, w[1:]))
        out[k] = (held[k], len(w), sum(x in u for x in w), n, sum(math.log10((u.get(x, 0) + 1) / (n + v + 1)) for x in w), s)
    return out


@pytest.mark.parametrize("block, parts, share", [(1 << 19, 32, 4), (50, 3, 4), (300, 7, 1000)])
def test_katz_scores_equal_the_recursion(spark, monkeypatch, block, parts, share):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "LEAST_PARTS", parts)
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    texts = random_texts(60)
    want = brute_katz(dict(enumerate(texts)))
    got = katz.train_and_score(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_katz_keeps_pairs_seen_once(spark):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2][:12]
    texts = [f"w{k % 4} w{k % 5} u{k} v{k}" for k in range(len(ids))]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("held_out", katz.held_out(katz.F.col("doc_id"), 7))
    words_, pairs, facts = katz.train(d.select("text"))
    seen = Counter(x for t in texts for x in zip([*words(t), None], [*words(t), None][1:]))
    assert pairs.count() == len(seen) and pairs.filter("c = 1").count() == sum(c == 1 for c in seen.values()) > 0
    assert 0 < facts["d2"][1] < 1


def test_katz_rows_between_stages_follow_the_text(spark):
    texts = random_texts(80, seed=5)
    sizes = []
    for times in (1, 4):
        blocks = katz.blocks_of(docs(spark, texts * times).select("doc_id", katz.F.lit(True).alias("learn"), "text"))
        _, _, facts, numbered = katz._learn(blocks)
        asked = numbered.drop("doc_id").mapInArrow(*katz._ask_pairs(facts["parts"]["pairs"], facts["hot"], False))
        sizes.append(asked.count() / numbered.count())
    assert max(sizes) <= katz.LEAST_PARTS  # a row a block and part, whatever the texts


def test_katz_takes_ids_of_other_types(spark):
    rows_ = [("x", "a b c"), (None, "a b"), ("x", "a b c"), ("y", None)]
    got = katz.train_and_score(spark.createDataFrame(rows_, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("None", 3), ("x", 4), ("x", 4), ("y", 1)]


def test_katz_of_nothing(spark):
    assert katz.train_and_score(docs(spark, [])).count() == 0


# 2


def labelled(spark):
    rng = random.Random(5)
    v = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    insults = ["fumblewit", "gronkhead", "snotlick"]
    texts, marks = [], []
    for k in range(500):
        w = rng.choices(v, k=rng.randint(10, 60))
        bad = k % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w)), marks.append(int(bad))
    return docs(spark, [*texts, "", None]), spark.createDataFrame([(k, 1, m) for k, m in enumerate(marks)] + [(10_000, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"), marks, v


def test_toxicity_on_held_out_and_disguised_texts(spark):
    d, labels, marks, v = labelled(spark)
    model = toxicity.train(d, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(d, model).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= toxicity.CUT) == bool(marks[k]) for k in held) >= 0.97 * len(held)
    assert got[500] < toxicity.CUT and got[501] < toxicity.CUT
    plain = " ".join(v[:20])
    hidden = [f"{plain} {x} {plain}" for x in ("f-u-m-b-l-e-w-i-t", "g r o n k h e a d", "GRONK.HEAD!", "snotxlick", "fumblewitz")]
    assert [r.toxicity >= toxicity.CUT for r in toxicity.score(docs(spark, [*hidden, plain]), model).orderBy("doc_id").collect()] == [True] * 5 + [False]
    kept = toxicity.reject(d, labels)
    assert kept.columns == d.columns and kept.count() < 502


def test_toxicity_is_the_kernel_machine_itself(spark):
    d, labels, _, v = labelled(spark)
    model = toxicity.train(d, labels)

    def triples(x):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def norm(n):
        return math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(n), 3) if k - i < toxicity.SPAN))

    marks = [(triples(z), norm(len(z))) for z in model["landmarks"]]
    for unit in ["fumblewit", "fuxmble", "gronkhead", *v[:20]]:
        if len(unit) >= 3:
            t = triples(unit)
            want = sum(a * sum(t[x] * n for x, n in z.items()) / size for a, (z, size) in zip(model["shares"], marks, strict=True)) / norm(len(unit)) + model["bias"]
            assert toxicity.best_margins(toxicity.pa.array([unit]), model["weights"], model["bias"])[0][0] == pytest.approx(want)


def test_toxicity_counts_characters_and_keeps_columns_of_any_name(spark):
    d, labels, _, v = labelled(spark)
    model = toxicity.train(d, labels)
    plain = " ".join(v[:20])
    hidden = [f"{plain} {x} {plain}" for x in ("fumb😀lewit", "gronk✨head", "snot🙂lick", "fum日blewit")]
    assert all(r.toxicity >= toxicity.CUT for r in toxicity.score(docs(spark, hidden), model).collect())
    clash = d.withColumn("toxicity", F.lit("x")).withColumn("_scored", F.lit(1)).withColumn("c0", F.lit(2))
    kept = toxicity.reject(clash, labels)
    assert kept.columns == clash.columns and kept.filter("toxicity <> 'x' OR c0 <> 2").count() == 0 and kept.count() == toxicity.reject(d, labels).count()
    assert toxicity.score(clash, model).columns == [*d.columns, "_scored", "c0", "toxicity"]


def test_toxicity_without_labels_of_both_kinds(spark):
    d, labels, _, _ = labelled(spark)
    assert {r.toxicity for r in toxicity.score(d, toxicity.train(d, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), toxicity.train(d, labels.limit(0))).count() == 0


# 3


def brute_components(data):
    sets = {}
    for k, t in data.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(data)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    chain = []
    for k in range(25):  # neighbours are similar, the ends are not
        base = base.copy()
        base[rng.randrange(80)] = f"n{k}"
        chain.append(" ".join(base))
    rng.shuffle(chain)
    texts = [*random_texts(60, seed=3), *chain]
    want = brute_components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == want
    kept = near_dup.deduplicate(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, x in want.items() if x[1] == k)
    assert kept.columns == docs(spark, texts).columns


def test_rows_of_near_duplicates_grow_with_members_not_with_pairs(spark, monkeypatch):
    texts = []
    for k in range(121):  # all share buckets, no two are similar enough: 0.70 or 0.74
        own = [f"w{at}" for at in range(174)]
        x, y = divmod(k, 11)
        for place in (x, 11 + y, 22 + (x + y) % 11):
            own[5 * place + 4] = f"n{k}-{place}"
        texts.append(" ".join(own))
    texts.append(texts[-1] + " more")
    rows, keep = {}, near_dup.stored

    def stored(df, what, *more):
        out = keep(df, what, *more)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "stored", stored)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)))
    assert len({c for _, c in got.values()}) == len(texts) - 1
    assert max(rows.values()) <= near_dup.BANDS * len(texts), rows


def test_near_duplicates_of_nothing_and_of_rows_without_id(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    two = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(two).collect()} == {(None, 2, 4, False), (4, 2, 4, True)}


# 4


def test_chat_events_fold_into_final_messages(spark):
    e = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", "assistant", "lo"),
        (1, 5, 2, "regenerate", "assistant", ""), (1, 6, 2, "delta", "assistant", "Bye</s>"), (1, 7, 1, "edit", "user", "hi!\\[x]"), (1, 8, 3, "message", "user", "gone"), (1, 9, 3, "delete", None, None), (2, 1, 1, "message", None, None),
    ]
    ev = spark.createDataFrame(e, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(ev))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hi!\\[x]"), ("assistant", "Bye</s>")] and got[1].loss_texts == ["Bye</s>"]
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[2].formatted == "<s>[]</s>"


def test_chat_of_ties_nulls_and_many_deltas(spark):
    kind = "conv_id long, seq long, message long, kind string, role string, text string"
    e = [(None, 1, 1, "message", "user", "x"), (3, 1, 1, "message", "user", "b"), (3, 1, 1, "edit", "user", "a"), (3, 1, 1, "message", "user", "c")]
    e += [(4, k, 1, "delta", "assistant" if k == 0 else None, f"{k},") for k in range(3000)]
    e += [(5, 1, 1, "message", "user", "old"), (5, 2, 1, "delete", None, None), (5, 3, 1, "delta", None, "new")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.parse(chat.render(chat.fold(spark.createDataFrame(e, kind)))).collect()}
    # of one seq the order is by kind, then text
    assert got == {None: [("user", "x")], 3: [("user", "c")], 4: [("assistant", "".join(f"{k}," for k in range(3000)))], 5: [("user", "new")]}
    assert chat.digests(chat.parse(chat.render(chat.fold(spark.createDataFrame([], kind))))).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    texts = ["</s>", "\\s\\l", "[INST] <s>", "]\\b[", "\\", "😀\n", ""]
    rows_ = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    r = chat.parse(chat.render(chat.fold(chat.rows_as_events(df)))).collect()[0]
    assert [tuple(t) for t in r.turns] == [(x[2], x[3]) for x in rows_] and r.loss_texts == texts[1::2]


# 5


def test_media_round_trip(spark):
    texts = random_texts(20) + ["y" * 576, "y" * 577, "z" * 576 * 40]
    for r in media.store_texts(docs(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > r.payload_bytes


def movie(*traks, more=b"", brand=b"ftyp"):
    return media._box(brand, b"isom", bytes(4)) + media._box(b"moov", *traks, more)


def trak(number, kind, codec, *tables, wide=False, scale=10, ticks=30):
    mdhd = struct.pack(">IQQIQHH", 1 << 24, 0, 0, scale, ticks, 0, 0) if wide else struct.pack(">IIIIIHH", 0, 0, 0, scale, ticks, 0, 0)
    stbl = media._box(b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(8))), *tables)
    return media._box(b"trak", media._full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0)), media._box(b"mdia", media._box(b"mdhd", mdhd), media._full(b"hdlr", bytes(4), kind, bytes(12)), media._box(b"minf", stbl)))


def chunks(offsets, per_chunk, wide=False):
    return [media._full(b"stsc", struct.pack(">IIII", 1, 1, per_chunk, 1)), media._full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets))]


def probe(x):
    return media.tracks(io.BytesIO(x), len(x))


def test_containers_of_other_shapes(spark):
    x = media.pack(b"q" * 576 * 30)
    got = media.probe(io.BytesIO(x), len(x))
    assert got["codec"] == "raw" and got["seconds"] == pytest.approx(1.2) and len(got["key_ranges"]) == 3
    assert all(x[a:b] == b"q" * 576 for a, b in got["key_ranges"])
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate((x, b"not a file", b"", None, x[:300]))], "id int, content binary, media string")
    out = [r.media for r in media.index_containers(df).orderBy("id").collect()]
    assert out[0].frames == 30 and len(out[0].tracks) == 1 and all(m.codec is None and m.error for m in out[1:])
    assert media.index_containers(df.limit(0)).count() == 0 and media.store_texts(docs(spark, [])).count() == 0


def test_container_tracks_sizes_and_tables():
    sizes = media._full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7))
    video = trak(1, b"vide", b"avc1", media._full(b"stss", struct.pack(">III", 2, 1, 3)), sizes, *chunks((100, 200), 2), wide=True, scale=1000, ticks=2500)
    sound = trak(2, b"soun", b"mp4a", media._full(b"stsz", struct.pack(">II", 4, 4)), *chunks((1 << 33, 300), 2, wide=True))
    one, two = probe(movie(video, sound))
    assert (one["id"], one["kind"], one["codec"], one["seconds"]) == (1, "vide", "avc1", 2.5)
    assert one["samples"] == [(100, 5), (105, 6), (200, 7)] and one["key_ranges"] == [(100, 105), (200, 207)]
    # without a table of key frames, all are
    assert two["codec"] == "mp4a" and two["seconds"] == 3 and two["key_ranges"] == [(1 << 33, (1 << 33) + 4), ((1 << 33) + 4, (1 << 33) + 8), (300, 304), (304, 308)]
    for bits, raw in ((4, bytes([0x56, 0x70])), (8, bytes([5, 6, 7])), (16, struct.pack(">HHH", 5, 6, 7))):
        small = trak(1, b"vide", b"avc1", media._full(b"stz2", struct.pack(">II", bits, 3), raw), *chunks((100,), 3))
        assert probe(movie(small))[0]["samples"] == [(100, 5), (105, 6), (111, 7)]


def test_container_boxes_of_64_bits_and_to_the_end():
    sound = trak(2, b"soun", b"mp4a", media._full(b"stsz", struct.pack(">II", 4, 2)), *chunks((50,), 2))
    wide = struct.pack(">I4sQ", 1, b"free", 16 + 9) + bytes(9)
    last = struct.pack(">I4s", 0, b"mdat") + bytes(1000)
    assert probe(wide + movie(sound) + last)[0]["samples"] == [(50, 4), (54, 4)]
    with pytest.raises(ValueError, match="does not fit"):
        probe(struct.pack(">I4s", 99, b"free"))


def test_container_fragments():
    head = movie(trak(7, b"vide", b"avc1", ticks=0), more=media._box(b"mvex", media._full(b"trex", struct.pack(">IIIII", 7, 1, 4, 9, 0x10000))))
    run = media._full(b"trun", struct.pack(">IiI", 2, 500, 0), flags=0x5)  # two samples from 500 on, the first a key frame
    sized = media._full(b"trun", struct.pack(">IIIII", 2, 3, 8, 3, 6), flags=0x300)  # ticks and sizes of their own, after the run before
    moof = media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run, sized))
    t = probe(head + moof + media._box(b"mdat", bytes(50)))[0]
    at = len(head) + 500
    assert t["samples"] == [(at, 9), (at + 9, 9), (at + 18, 8), (at + 26, 6)] and t["key_ranges"] == [(at, at + 9)] and t["seconds"] == pytest.approx((4 + 4 + 3 + 3) / 10)


# 6


def test_token_counts_in_small_blocks_and_of_nothing(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(token_counts, "LEAST_PARTS", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    texts = random_texts(30)
    got = token_counts.count_tokens(docs(spark, texts).unionByName(docs(spark, texts)), tokenizer_path(token_counts.MODEL)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k, len(sp.encode(t or ""))) for k, t in enumerate(texts) for _ in range(2))
    assert token_counts.count_tokens(docs(spark, []), tokenizer_path(token_counts.MODEL)).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    texts = [*random_texts(30), " ", "  a  b ", "\n\n x", "<s> </s>", "▁x ▁", "a▁b", "\r\n {\r", "日本 語😀", "tab\tand\x00nul"]
    for r in token_counts.count_tokens(docs(spark, texts), tokenizer_path(token_counts.MODEL)).collect():
        n = len(sp.encode(texts[r.doc_id] or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 4096)


# 7


def test_decontamination_finds_passages_and_spares_others(spark):
    rng = random.Random(2)
    item = [f"t{rng.randrange(10**6)}" for _ in range(40)]
    noise = lambda n: [f"d{rng.randrange(10**6)}" for _ in range(n)]
    swapped = item.copy()
    for k in range(3, 40, 9):
        swapped[k] = "other"
    texts = [" ".join(noise(50) + item + noise(9)), " ".join(noise(9) + [w.upper() for w in swapped]), " ".join(item[:13]), " ".join(noise(30) + item[:6] + noise(30)), " ".join(noise(80)), "", None, " ".join(item[5:20])]
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, "too short", 0), (3, None, 0), (4, " ".join(item), 0)], "item_id long, text string, doc_id int")
    for limit in (1 << 25, -1):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), items, broadcast_bytes=limit).collect()}
        assert got == {(d, i) for d in (0, 1, 2, 7) for i in (1, 4)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, texts), items).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs(spark, texts), items.limit(0)).count() == 0


def test_every_overlap_of_an_item_has_a_seed():
    spots = [[k for k, bit in enumerate(m) if bit == "1"] for m in decontaminate.MASKS]
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        differ = n * (100 - decontaminate.NEED) // 100
        for other in itertools.combinations(range(n), differ):
            assert any(not {at + k for k in s} & set(other) for s in spots for at in range(n - s[-1]))


def test_all_ways_to_differ_in_three_of_thirteen_tokens(spark):
    item = [f"t{k}" for k in range(13)]
    ways = [set(x) for x in itertools.combinations(range(13), 3)]
    texts = [" ".join(f"x{k}" if k in w else t for k, t in enumerate(item)) for w in ways]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for limit in (1 << 25, -1):
        got = decontaminate.contaminated(docs(spark, texts), items, broadcast_bytes=limit).collect()
        assert len(got) == len(ways) == 286 and {(r.matched, r.first_word, r.hits) for r in got} == {(10, 0, 1)}


def brute_overlaps(texts, items):
    out = defaultdict(set)
    for d, t in texts.items():
        for i, u in items.items():
            a, b = words(t), words(u)
            size = min(len(b), decontaminate.WINDOW)
            need = decontaminate.NEED if len(b) >= decontaminate.SHORTEST else 100
            for p in range(-size, len(a)):
                for q in range(len(b) - size + 1 if b else 0):
                    same = sum(0 <= p + k < len(a) and a[p + k] == b[q + k] for k in range(size))
                    if 100 * same >= need * size:
                        out[d, i].add((p, q, same))
    return {k: (max(x[2] for x in v), max(0, min(x[0] for x in v)), len(v)) for k, v in out.items()}


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(11)
    items = {k: " ".join(rng.choices("abcdefghij", k=n)) for k, n in enumerate((1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30))}
    texts = {k: " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 40))) for k in range(30)}
    for k in range(30, 60):
        w = rng.choice(list(items.values())).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "z"
        texts[k] = " ".join([*rng.choices("klmnop", k=rng.randint(0, 5)), *w, *rng.choices("klmnop", k=3)][rng.randint(0, 3) :])
    got = decontaminate.contaminated(docs(spark, [texts[k] for k in sorted(texts)]), spark.createDataFrame(list(items.items()), "item_id long, text string"), broadcast_bytes=limit)
    assert {(r.doc_id, r.item_id): (r.matched, r.first_word, r.hits) for r in got.collect()} == brute_overlaps(texts, items)


def test_a_join_of_many_items_moves_no_token_lists(spark, capsys):
    items = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(20)))], "item_id long, text string")
    found = decontaminate._hits(*(lambda t, i: (t, i, decontaminate.MASKS, 13, (t.withColumn("doc_row", F.lit(1)), i.withColumn("item_row", F.lit(1)))))(
        docs(spark, ["a b"]).select("doc_id", decontaminate.tokens(F.col("text")).alias("doc")), items.select("item_id", decontaminate.tokens(F.col("text")).alias("item"))))
    found.explain("formatted")
    dealt = [x for x in capsys.readouterr().out.split("\n(") if "Exchange" in x.split("\n")[0] and "seed" in x]
    assert dealt and not any("doc#" in x or "item#" in x for x in dealt)


def test_decontamination_finds_overlaps_wherever_tokens_differ(spark):
    items = {1: [f"a{k}" for k in range(20)], 2: [f"b{k}" for k in range(8)], 3: [f"c{k}" for k in range(12)], 4: ["d0", "d1", "d2"], 5: ["e0"]}
    swap = lambda w, *ks: [f"x{k}" if k in ks else x for k, x in enumerate(w)]
    noise = [f"n{k}" for k in range(30)]
    cases = [(swap(items[1][:13], 0, 3, 5), {1}), (swap(items[2], 3), {2}), (swap(items[2], 2, 5), {2}), (swap(items[3], 2, 5, 8), {3}), (items[4], {4}), (swap(items[4], 1), set()), (items[5], {5}), (swap(items[1][:13], 0, 3, 5, 8), set()), (swap(items[2], 1, 3, 6), set())]
    texts = docs(spark, [" ".join(noise + w + noise) for w, _ in cases])
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(texts, tests).collect()}
    assert got == {(k, i) for k, (_, own) in enumerate(cases) for i in own}
    assert sorted(r.doc_id for r in decontaminate.clean(texts, tests).collect()) == [5, 7, 8]


# 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Real &amp; title</h1></header><p>One&nbsp;two <b>three</b><br>four<p>Be.<aside>Side</aside><div class="ad">Buy</div>
<form><label>Mail</label></form><script>if (a<b) "</p>"</script><!-- x --><section id="comments"><p>Nice post, thank you!</p></section><p hidden>no</p><ul><li>item</ul><p>End 5 &lt; 6.</article><footer>c</footer></body></html>"""


def test_html_keeps_the_article_alone(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>", "x"), (5, "u", "<nav><a>x</a></nav><!-- open", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == "Real & title\nOne two three four\nBe.\nno\nitem\nEnd 5 < 6." and set(got.values()) == {got[1], ""}


def test_html_on_pages_of_other_layouts():
    kept = right = wanted = 0
    for k, p in enumerate(pages.PAGES):
        page = html_text.read(fill(p, 1000 + k))
        for x, b in zip(html_text.features(page), page.blocks, strict=True):
            kept += b.words * html_text.judge(x)
            right += b.words * html_text.judge(x) * b.within.main
            wanted += b.words * b.within.main
    assert len(pages.PAGES) >= 20 and right / kept >= 0.98 and right / wanted >= 0.98


def test_html_names_of_wrappers_do_not_empty_a_page():
    say = lambda n, k: fill(f"~{n}~", k)
    a, b, c = say(8, 1), say(40, 2), say(60, 3)
    for page in (
        f'<article class="post no-comments"><h1>{a}</h1><p>{b}</p></article>',
        f'<div class="content no-sidebar"><h1>{a}</h1><p>{b}</p><p>{c}</p></div>',
        f'<article><div class="entry-header"><h1>{a}</h1></div><p>{b}</p></article>',
        f'<div class="sidebar"><h1>{a}</h1><p>{b}</p><p>{c}</p></div>',
    ):
        assert html_text.main_text(page).split("\n")[:2] == [a, b]
    assert html_text.main_text(f"<article><p>{b}</p><p>x <math><mi>y</mi></math> <svg><text>z</text></svg></p><p>{c}</p></article>") == f"{b}\nx y z\n{c}"


@pytest.mark.parametrize("page", ["<p>Hello world</p>", "<div>only a few words here</div>", "<div>" + "".join(f"<p>line {k} of a poem</p>" for k in range(12)) + "</div>", "<body><nav><a href=1>Home</a></nav><p>One line.</p></body>"])
def test_html_keeps_short_pages_whole(page):
    want = re.findall(r"<(?:p|div)>([^<]+)", page)
    assert html_text.main_text(page) == "\n".join(want)


def test_html_keeps_lists_talk_and_linked_titles():
    long = "Here is a paragraph of some length that says one thing after another, as paragraphs do, and then ends. " * 3
    recipe = "<body><div class=menu><a href=1>Home</a></div><div><h1>Soup</h1><ul>" + "".join(f"<li>{x}</li>" for x in ("two onions", "salt", "a leek", "one litre of water", "oil")) + f"</ul><p>{long}</p></div></body>"
    assert html_text.main_text(recipe).split("\n")[:6] == ["Soup", "two onions", "salt", "a leek", "one litre of water", "oil"]
    talk = f"<body><div><p>{long}</p><p>Yes.</p><p>No.</p><p>Why not?</p><p>{long}</p></div></body>"
    assert html_text.main_text(talk).split("\n")[1:4] == ["Yes.", "No.", "Why not?"]
    title = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h1><a href=3>A linked title of a page</a></h1><p>{long}</p><p>{long}</p></body>"
    assert html_text.main_text(title).split("\n")[0] == "A linked title of a page"
    links = f"<article><h1>T</h1><p>{long}</p><p><a href=1>See also</a></p><ul><li><a href=2>one</a></li><li><a href=3>two</a></li></ul></article>"
    assert html_text.main_text(links).split("\n")[2:] == ["See also", "one", "two"]


class Splitter(HTMLParser):
    """Text blocks of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.part, self.skip = [], "", 0

    def cut(self):
        text = " ".join(self.part.split())
        self.blocks += [text] if text else []
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.skip += 1
        elif tag in html_text.BLOCKS:
            self.cut()
        elif tag == "br":
            self.part += " "

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.skip = max(0, self.skip - 1)
        elif tag in html_text.BLOCKS:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            self.part += data


def blocks_by_parser(page):
    s = Splitter()
    s.feed(page)
    s.close()
    s.cut()
    return s.blocks


def test_html_blocks_are_those_of_the_standard_parser(spark):
    some = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()]
    for page in [*some, *(fill(p, 5 + k) for k, p in enumerate(pages.PAGES)), *(fill(p, k) for k, p in enumerate(html_text.PAGES))]:
        assert [b.text for b in html_text.read(page).blocks] == blocks_by_parser(page)


def test_html_of_long_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "<p>" + fill("~30~", 1) + "</i>" * 20_000
    long = "<article>" + f"<p>{fill('~30~', 2)}</p>" * 3_000 + "</article>"
    df = spark.createDataFrame([(1, "u", deep), (2, "u", long), (2, "u", long)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert sorted(len(r.text.split()) for r in got) == [30, 90_000, 90_000] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


# 9


def test_mixing_reaches_its_budgets(spark):
    d = docs(spark, random_texts(400)).cache()
    got = mixing.mix(d).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * total)
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 2 * x[0].source_size + 1e-6
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(r.size for r in x)
        assert all(r.taken <= 2 * r.size for r in x)
    again = mixing.mix(d.repartition(7), ranges=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs(spark, [])).count() == 0 and {r.taken for r in mixing.mix(docs(spark, ["", None])).collect()} == {0}


# 10


def test_archives_of_long_and_repeated_payloads(spark):
    big = "<p>" + "long " * 50_000
    pages = [(5, "http://x/ y", big), (2, None, big), (9, "u", "tiny"), (3, "u", "tiny"), (7, "u", None), (8, "u\n", "é" * 60), (6, "u", "é" * 60), (6, "u", "é" * 60), (None, "u", "é" * 60)]
    got = [tuple(r) for r in warc.archive_and_read(spark.createDataFrame(pages, "page_id long, url string, html string"), chunk=4096).drop("url").collect()]
    want = []
    for k, _, t in pages:
        raw = (t or "").encode()
        first = min((i for i, _, u in pages if u == t and i is not None), default=None)
        again = len(raw) >= 100 and k != first
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_warc_of_a_very_long_url(spark):
    pages = [(1, "http://a/" + "\x01" * 30_000, "<p>x</p>"), (2, "http://b/", "y")]
    got = warc.archive_and_read(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, 8), (2, 1)]


def test_warc_records_have_dates_and_identifiers_of_their_own(spark, tmp_path):
    pages_ = [(1, "http://a/é", "x" * 200), (1, "http://a/é", "x" * 200), (2, None, "x" * 200)]
    df = spark.createDataFrame(pages_, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"), date="2024-05-06T07:08:09Z")
    heads = [warc._fields(bytes(r.content).split(b"\r\n\r\n")[0]) for r in spark.read.parquet(str(tmp_path / "a")).collect()]
    assert len({h["warc-record-id"] for h in heads}) == 3 and {h["warc-date"] for h in heads} == {"2024-05-06T07:08:09Z"}
    got = warc.read_archive(spark.read.parquet(str(tmp_path / "a"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.url) for r in got) == [(1, "response", None, "http://a/é")] * 2 + [(2, "revisit", 1, None)]
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_a_changed_archive_is_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a")).withColumn("content", F.replace(F.col("content").cast("string"), F.lit("xxx"), F.lit("xyx")).cast("binary"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(bad).collect()


# the pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    state = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.select("doc_id", "text").collect()} if name != "mixing" else {}
        out = stage(spark, state, SF).cache()
        if name == "near_dup":
            want = brute_components(before)
            assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, x in want.items() if x[1] == k)
        if name != "mixing":
            assert out.columns == state.columns and set(r.doc_id for r in out.collect()) <= set(before)
            state = out
    assert sorted(map(str, out.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    # the last stage gives the documents whole, with what the mix takes of them
    texts = {r.doc_id: (r.text, r.lang) for r in state.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(state).collect() if r.taken}
    assert set(state.columns) < set(out.columns) and {r.doc_id: (r.text, r.lang) for r in out.collect()} == {k: texts[k] for k in taken} and {r.doc_id: r.taken for r in out.collect()} == taken


def test_mixing_stage_with_repeated_rows_nulls_and_clashes(spark):
    import corpus_pipeline

    rows_ = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b d", "s"), (None, "x y", None), (2, None, "t"), (3, "e f g h", "t")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows_], "doc_id long, text string, source string, size int, lang string")
    out = corpus_pipeline.stage_mixing(spark, df, SF)
    want = sorted(str((r.doc_id, r.source, r.size, r.taken)) for r in mixing.mix(df).filter("taken > 0").collect())
    assert sorted(str((r.doc_id, r.source, r["size"], r.taken)) for r in out.collect()) == want


@pytest.mark.parametrize("parts", [64, 100_000])
def test_a_block_visits_only_the_parts_that_it_needs(parts):
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    got = katz._ranges(keys, parts)
    assert len(got) <= min(500, parts) and [i for _, i, _ in got] == [0, *[j for _, _, j in got[:-1]]] and got[-1][2] == 500
    assert [p for p, _, _ in got] == sorted({p for p, _, _ in got}) and all(0 <= p < parts for p, _, _ in got)
    assert katz._runs(np.zeros(0, np.int64)) == []


def test_toxicity_takes_text_ids(spark):
    rng = random.Random(2)
    texts = [(f"d{k}", " ".join(rng.choices(["good", "fine", "calm", "vile" if k % 2 else "kind"], k=9)), k % 2) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id string, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert toxicity.score(df.select("doc_id", "text"), model, keep=["doc_id"]).count() == 60

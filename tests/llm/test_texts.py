import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import licenses, multiset_hash, sentence_spans, warc
from panelforge.llm.multiset_hash import Fingerprint
from panelforge.llm.queries import op6_license_scan, op7_sentence_span_dedup, op8_multiset_fingerprints, op9_warc_round_trip

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# ---- licenses
def test_license_base_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_license_scan(spark, sf).collect():
        w, starts, found = words(docs[r.doc_id]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    found.add(label)
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(starts), ",".join(sorted(found)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert found <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_edits():
    hit = licenses.scan(b"Distributed under the GNU Genral Public Licence today")
    assert hit["places"] == [] and [(x[0], x[1], x[2]) for x in hit["spans"]] == [("gpl", 3, 7)] and 0.8 < hit["score"] < 1
    assert licenses.scan(b"a gnu generous republic licked it")["spans"] == []
    assert licenses.scan(b"commit license")["spans"] == []
    many = licenses.scan(b"MIT License. " * 3)
    assert [s for s, _ in many["places"]] == [0, 2, 4]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(list(licenses.NOTICES)), st.integers(0, 10**6))
def test_license_seeds_miss_nothing(phrase, seed):
    """A notice with as many random edits as allowed is found, whatever they are."""
    notice, rng = licenses.Notice(phrase, "x"), random.Random(seed)
    text = list(phrase)
    for _ in range(rng.randint(0, notice.edits)):
        k = rng.randrange(1, len(text) - 1)
        if text[k] != " ":
            text[k] = rng.choice("abcxyz")
    line = b" some words " + "".join(text).encode() + b" and more "
    assert notice.spans(line)


def test_license_whose_last_word_goes_on():
    """The edit that ends with the word counts, although the notice stands there without one."""
    for text, label in ((b"mit licensed", "mit"), (b"see the MIT licenses today", "mit"), (b"apache licensed here", "apache"), (b"xmit license", "mit")):
        assert [(x, d) for x, _, _, d in licenses.scan(text)["spans"]] == [(label, 1)], text


def test_license_awkward(awkward, empty):
    rows = licenses.scan_documents(awkward).collect()
    assert len(rows) == awkward.count()
    none = [r for r in rows if r.doc_id == 4][0]
    assert (none.n_words, none.n_base, none.first_word, none.base_labels, none.labels, none.score) == (0, 0, None, "", "", 0.0)
    assert [r.base_labels for r in rows if r.doc_id == 12] == ["apache"]
    assert licenses.scan_documents(empty).count() == 0


# ---- sentence spans
def passage(rng, n):
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(4, 14))) + "." for _ in range(n)]


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(4)
    shared = " ".join(passage(rng, 8))
    rows = [(i, " ".join(passage(rng, 5)) + " " + (shared if i in (3, 7, 9) else "") + " " + " ".join(passage(rng, 4))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs).collect()}
    assert [i for i in got if got[i].n_removed] and {i for i in got if got[i].n_removed} == {7, 9}
    for i, t in rows:
        if i not in (7, 9):
            assert got[i].text == t
        else:
            assert len(got[i].text) <= len(t) - 0.8 * len(shared) and got[i].text[:40] == t[:40] and got[i].text[-30:] == t[-30:]


def test_any_fifty_words_hold_a_span():
    """The same 50 words in two contexts share a span, without punctuation, on a line of their own or cut mid-sentence."""
    rng = random.Random(9)

    def draw(n, stops):
        return " ".join(rng.choice(["al", "be", "ga", "de", "ep"]) + str(rng.randint(0, 99)) + ("." if rng.random() < stops else "") for _ in range(n))

    for k in range(2000):
        stops, gap = rng.choice([0, 0, 0.05, 0.1, 0.3]), rng.choice([" ", "\n"])
        own = draw(50, stops)
        one, two = ({*sentence_spans.spans((draw(rng.randint(0, 30), stops) + gap + own + gap + draw(rng.randint(0, 30), stops)).encode())[0].tolist()} for _ in range(2))
        assert one & two, (k, own)


def test_spans_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    seen, removed = {}, {}
    for i, t in docs:
        raw = t.encode()
        a, b, n, _ = sentence_spans.sentences(raw)
        units = [b" ".join(raw.lower()[x:y].split()) for x, y in zip(a, b, strict=True)]
        for k in range(len(units)):
            total, j = 0, k
            while j < len(units) and (j - k < 3 or total < 20):
                total += int(n[j])
                j += 1
            if j - k >= 3 and total >= 20:
                if (run := (b" ".join(units[k:j]), j - k)) in seen:
                    removed.setdefault(i, set()).update(range(k, j))
                else:
                    seen[run] = (i, k)
    got = {r.doc_id: r.n_removed for r in op7_sentence_span_dedup(spark, sf).collect()}
    assert got == {i: len(removed.get(i, ())) for i, _ in docs}


def test_hot_spans_are_dealt_in_pieces(spark, monkeypatch):
    """Dealing the frequent hashes in pieces changes nothing: 200 copies and near copies, ids given once and twice."""
    rng = random.Random(11)
    hot = passage(rng, 12)
    rows = [(i, " ".join(hot if i % 3 == 0 else [*hot[:6], *passage(rng, 4)] if i % 3 == 1 else passage(rng, 6))) for i in range(300)]
    monkeypatch.setattr(sentence_spans, "SAMPLE", 1)
    for rows in (rows, [*rows, (7, "another text"), (0, rows[0][1]), (None, rows[0][1])]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        keyed = sentence_spans._named(docs, "doc_id", False).select(F.col("doc_id").alias("__id"), "__hash", F.encode("text", "UTF-8").alias("__text"), F.xxhash64("__key").alias("__pick"))
        assert max(sentence_spans._hot(keyed, 3, 20).values()) > 10
        got = sorted((str(r.doc_id), r.text, r.n_removed) for r in sentence_spans.remove_repeats(docs).collect())
        with monkeypatch.context() as m:
            m.setattr(sentence_spans, "_hot", lambda *_: {})
            assert got == sorted((str(r.doc_id), r.text, r.n_removed) for r in sentence_spans.remove_repeats(docs).collect())
        assert sum(n > 0 for _, _, n in got) >= 198


def test_spans_awkward(awkward, empty):
    rows = sentence_spans.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.text is None and r.n_sentences == 0 for r in rows if r.doc_id == 4)
    assert sentence_spans.remove_repeats(empty).count() == 0
    clash = awkward.withColumn("n_removed", F.lit("x")).withColumn("removed", F.lit(2)).withColumn("N_Sentences", F.lit(3))
    out = sentence_spans.remove_repeats(clash)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and dict(out.dtypes)["n_removed"] == "bigint" and out.count() == awkward.count()


# ---- multiset fingerprints
@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab\r é", max_size=5), max_size=8), st.randoms())
def test_fingerprint_algebra(parts, rng):
    whole = Fingerprint.of("\n".join(parts).encode())
    shuffled = parts[:]
    rng.shuffle(shuffled)
    assert whole == Fingerprint.of("\n".join(shuffled).encode())
    total = Fingerprint()
    for p in parts:
        total = total + Fingerprint.of(p.encode())
    assert total == whole
    if parts:
        assert whole - Fingerprint.of(parts[0].encode()) == Fingerprint.of("\n".join(parts[1:]).encode())


def test_likeness_follows_shared_paragraphs():
    lines = [f"paragraph number {i}" for i in range(60)]
    a = Fingerprint.of("\n".join(lines).encode())
    near = [a.likeness(Fingerprint.of("\n".join(lines[:k] + [f"other {i}" for i in range(60 - k)]).encode())) for k in (60, 54, 30, 0)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] >= 0 and near[1] > 0.7 and near[3] < 0.35


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_fingerprint_query(spark, sf, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in op8_multiset_fingerprints(spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == Fingerprint.of(t.encode()).hex() and r.edited_fingerprint == Fingerprint.of(new.encode()).hex()
        assert r.near_next == pytest.approx(Fingerprint.of(t.encode()).likeness(Fingerprint.of(nxt.encode())))
    assert len(got) == len(docs)


def test_fingerprint_awkward(spark, awkward, empty):
    rows = multiset_hash.fingerprint_documents(awkward).collect()
    assert len(rows) == awkward.count() and len({r.fingerprint for r in rows if r.doc_id in (1, 2, 10)}) == 1
    assert all(r.n_chars == 0 and set(r.fingerprint) == {"0"} for r in rows if r.doc_id in (4, 5))
    assert multiset_hash.fingerprint_documents(empty).count() == 0
    alone = multiset_hash.fingerprint_documents(awkward.filter("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    many = spark.range(200).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    assert multiset_hash.fingerprint_documents(many).count() == 200


# ---- archives
def records(found):
    return [(h.get("warc-record-id"), b) for kind, _, _, h, b in found if kind == "record"]


def archive(packed):
    parts = [warc.page_record(str(i), f"http://x/{i}", f"<p>{i}</p>".encode() * (50 + i), None, False) for i in range(12)]
    return [warc.member(p) for p in parts] if packed else parts


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = archive(packed)
    whole = b"".join(parts)
    sound = records(warc.salvage(whole))
    assert len(sound) == 12 and all(k == "record" for k, *_ in warc.salvage(whole))
    for seed in range(40):
        rng = random.Random(seed)
        data = bytearray(whole)
        k = rng.randrange(len(parts))
        at = sum(map(len, parts[:k])) + rng.randrange(len(parts[k]))
        mode = rng.choice(["flip", "cut", "insert"])
        if mode == "flip":
            data[at] ^= 1 << rng.randrange(8)
        elif mode == "cut":
            del data[at : at + rng.randrange(1, 30)]
        else:
            data[at:at] = rng.randbytes(rng.randrange(1, 30))
        got = list(warc.salvage(bytes(data)))
        lost = [r for r in sound if r not in records(got)]
        assert len(lost) <= 2, (seed, mode)
        edges = [(a, b) for _, a, b, *_ in got]
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(edges, edges[1:], strict=False))


def test_salvage_of_rubbish():
    assert list(warc.salvage(b"")) == []
    assert [k for k, *_ in warc.salvage(b"no archive at all")] == ["gap"]
    assert [k for k, *_ in warc.salvage(archive(True)[0][:-3])] == ["gap"]
    assert [k for k, *_ in warc.salvage(b"junk" + b"".join(archive(True)))][:2] == ["gap", "record"]
    assert zlib.decompress(archive(True)[0], 31) == archive(False)[0]


def test_round_trip_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    twice = pages.unionByName(pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000))
    rows = {r.page_id: r for r in warc.round_trip(twice).collect()}
    raw = {r.page_id: (r.html or "").encode() for r in twice.collect()}
    last = {}
    for i, h in raw.items():
        last[h] = max(i, last.get(h, -1))
    assert set(rows) == set(raw)
    for i, h in raw.items():
        revisit = len(h) >= 1000 and last[h] != i
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(h), hashlib.sha1(h).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if revisit else ("response", None))
    assert op9_warc_round_trip(spark, sf).count() == pages.count()


def test_payloads_come_back_whole(spark, tmp_path):
    body = "<p>é漢</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = spark.createDataFrame([(1, "http://a b\n", body), (2, None, None), (None, "u", "x" * 1500), (None, "u", "x" * 1500), (3, "u", ""), (3, "u", "y" * 2000), (4, "u", "y" * 2000)], "page_id long, url string, html string")
    folder = str(tmp_path / "arc")
    manifest = warc.write_archives(warc.plan_records(pages), folder, rotate=100)
    got = warc.read_archives(manifest, folder).collect()
    assert all(r.kind == "record" for r in got) and len(got) == 7
    assert [bytes(r.payload).decode() for r in got if r.record_id == "1"] == [body]
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 2000) == [("3", "revisit", "4"), ("4", "response", None)]
    assert {r.record_type for r in got if r.record_id is None} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_numpy_powers():
    for held in sentence_spans._POWERS.values():
        up, down = held.upto(9)
        assert (up * down == np.ones(len(up), np.uint64)).all()


def test_unlike_texts_of_many_paragraphs():
    for n in (100, 20_000, 40_000, 100_000):
        a, b = (Fingerprint.of((line + "\n").encode() * n) for line in ("one line", "another line"))
        assert a.likeness(b) < 0.5 and a.likeness(a) == 1 and (a - a) == Fingerprint()
    a, b = (Fingerprint.of("\n".join(f"{w} {i}" for i in range(40_000)).encode()) for w in "ab")
    assert a.likeness(b) < 0.4


def test_fingerprints_of_any_ids(spark):
    """Text ids and longs over 2**53 follow in their exact order."""
    big = 1 << 60
    for ids, kind in (([big + i for i in range(40)], "long"), ([f"id-{i:03d}" for i in range(40)], "string"), ([*range(38), None, None], "long")):
        rows = [(i, f"text {k} " * (k + 1)) for k, i in enumerate(ids)]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
        got = {r.n_chars: r for r in multiset_hash.fingerprint_documents(docs).collect()}
        order = sorted((r for r in rows if r[0] is not None), reverse=True)
        for (_, t), (_, nxt) in zip(order, order[1:], strict=False):
            new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            assert got[len(t)].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert len(got) == len(rows)


def edit_distances(pattern, line):
    """Least edits with which ``pattern`` matches a stretch of ``line`` that starts and ends with words: brute force."""
    words, best = line.split(), {}
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + len(pattern.split()) + 3) + 1):
            t = " ".join(words[i:j])
            if abs(len(t) - len(pattern)) > len(pattern) // 12 + 1:
                continue
            row = list(range(len(t) + 1))
            for x, c in enumerate(pattern, 1):
                left, row[0] = row[0], x
                for y, d in enumerate(t, 1):
                    left, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, left + (c != d))
            best[i, j] = row[-1]
    return best


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(list(licenses.NOTICES)), st.integers(0, 10**9))
def test_license_spans_against_edit_distance(phrase, seed):
    """Insertions, deletions and changes anywhere, both ends included: a span is reported if and only if brute force has one, and each is within the bound."""
    notice, rng = licenses.Notice(phrase, "x"), random.Random(seed)
    text = list(phrase)
    for _ in range(rng.randint(0, notice.edits + 1)):
        k, how = rng.randrange(len(text)), rng.randrange(3)
        if how == 0:
            text[k] = rng.choice("abest ")
        elif how == 1:
            text.insert(rng.choice([0, k, len(text)]), rng.choice("sdx "))
        else:
            del text[k]
    line = " ".join(f"{rng.choice(['under', 'x', 'a'])} {''.join(text)} {rng.choice(['s', 'and', 'license'])}".split())
    want = {k: d for k, d in edit_distances(phrase, line).items() if d <= notice.edits}
    got = notice.spans(b" " + line.encode() + b" ")
    assert bool(got) == bool(want), (line, want)
    if want:
        assert min(d for _, _, d in got) == min(want.values()), (line, want, got)


def test_license_inputs_of_before():
    for text, label in ((b"gnu general public licensee", "gpl"), (b"gnu general public licenses", "gpl"), (b"apache licenses", "apache"), (b"mozila public license", "mpl"), (b"gnu generl public license", "gpl")):
        assert label in {s[0] for s in licenses.scan(text)["spans"]}, text

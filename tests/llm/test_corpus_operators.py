"""URL filters, near duplicates, fingerprints, records, token counts and the pipeline: against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import golay, oph, records, sepscan, simhash, urlrep
from ledgerloom.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, WORD_BPE, tokenizer_path
from test_likeness import groups_brute


def docs_of(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


# urls -----------------------------------------------------------------------------------------------------------------


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    hits = [r for r in urlrep.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(hits, key=lambda r: len(r.name)) if hits else None


def test_op5_parts_and_rules(spark, data):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/../sf0.01/pages.parquet").collect()}
    for r in QUERIES["op5_url_filter"](spark, f"{data}/../sf0.01").collect():
        host, path = parts(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_reputation_blocks_the_bad_and_shrinks_the_unknown(spark):
    rows = [("bad.example.info", 1)] * 60 + [("good.example.info", 0)] * 60 + [("new.example.info", 1)] * 1 + [("ok.other.biz", 0)] * 40
    post = {r.host: r for r in urlrep.posteriors(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert post["bad.example.info"].lower > urlrep.THRESHOLD > post["good.example.info"].mean
    assert post["new.example.info"].lower < urlrep.THRESHOLD and post["new.example.info"].mean < 1
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://bad.example.info/x", "http://BAD.example.info", "http://x.bad.example.info/", "https://a.net/", "://h/p?q", "http://a.net", "http://x.example.net/en/1", "http://u.example.com/de/", "http://z.org/fr/", None])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrep.judged(pages, spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got[0] == ("bad.example.info", "/x", None, "block") and got[1][3] == "block" and got[2][3] == "allow"
    assert got[3] == ("a.net", "/", "net/", "block") and got[4] == ("h", "/p", None, "allow") and got[5] == ("a.net", "", None, "allow")
    assert got[6][2:] == ("example.net/en/", "allow") and got[7][2:] == ("example.com/de/", "block") and got[8][2:] == ("org/fr/", "allow") and got[9] == ("", "", None, "allow")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, data):
    import duckdb

    sf, con = f"{data}/../sf0.01", duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [list(want.columns).index(n) for n in names]
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


# near duplicates ----------------------------------------------------------------------------------------------------


def test_golay_indices_meet_within_two_bits():
    leaders = golay.ERRORS[:, 0]
    for e in [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i in range(23) for j in range(i))]:
        (a, ma), (b, mb) = golay.nearby(leaders), golay.nearby(leaders ^ e)
        assert ((a[:, :, None] == b[:, None, :]) & ma[:, :, None] & mb[:, None, :]).any((1, 2)).all()


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ka, ra), (kb, rb) = simhash.keys_of(a), simhash.keys_of(b)
    both = set(zip(ka.tolist(), ra.tolist())) & set(zip(kb.tolist(), rb.tolist()))
    assert {r for _, r in both} == set(range(len(a)))


def brute_components(fps):
    """fps: {doc_id: int}. Smallest reachable id by breadth-first search over all pairs."""
    ids, left, out = sorted(fps), set(fps), {}
    for d in ids:
        if d not in left:
            continue
        queue = [d]
        left.discard(d)
        while queue:
            x = queue.pop()
            out[x] = d
            near = [y for y in left if (fps[x] ^ fps[y]).bit_count() <= 4]
            left -= set(near)
            queue += near
    return out


def fingerprint_brute(text):
    import xxhash

    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(len(words) - 3)] or [xxhash.xxh64(" ".join(words).encode(), 42).intdigest()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6(spark, data):
    sf = f"{data}/../sf0.01"
    fps = {d: fingerprint_brute(t) for d, t in docs_of(spark, sf).items()}
    want = brute_components(fps)
    got = QUERIES["op6_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 8])
def test_crowded_fingerprints(spark, bucket):
    """Chains and balls of close fingerprints; a tiny bucket sends them through the second pass."""
    rng, fps = random.Random(5), set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            fps.add(at)
            at ^= 1 << rng.randrange(64) if rng.random() < 0.7 else sum(1 << b for b in rng.sample(range(64), 5))
    fps |= {fps_ ^ (1 << b) for fps_ in list(fps)[:3] for b in range(64)}
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    from ledgerloom.llm.components import connected

    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in connected(simhash.links(df, bucket), "a", "b").collect()}
    want = brute_components({f: f & (2**64 - 1) for f in fps})
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


# fingerprints ---------------------------------------------------------------------------------------------------------


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("rows", [oph.RANGE_ROWS, 7])
def test_op7(spark, data, rows):
    docs = docs_of(spark, data)
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = oph.compared(df, rows=rows).collect()
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    errors, prints = [], {}
    assert len(got) == len(docs)
    for r in got:
        text, following = docs[r.doc_id], docs[after[r.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        likeness = lambda a, b: len(a & b) / len(a | b)
        errors += [r.near_edited - likeness(shingles(text), shingles(edited)), r.near_next - likeness(shingles(text), shingles(following))]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if text == following:
            assert r.near_next == 1
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).mean() < 0.03


def test_sparse_fingerprints_are_dense_and_alike(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, ""), (5, None)], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in oph.fingerprints(df).collect()}
    assert all(len(x) == 2 * oph.BINS for x in f.values()) and f[1] == f[2] != f[3] and f[4] == f[5]


# files ----------------------------------------------------------------------------------------------------------------


def crc32c_brute(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (records.POLYNOMIAL if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    blobs = [b"", b"a", b"123456789", b"\0" * 9, *[rng.randbytes(rng.randrange(400)) for _ in range(80)]]
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    assert records.crc32c(blobs).tolist() == [crc32c_brute(b) for b in blobs]


def test_op8(spark, data):
    from tokenizers import Tokenizer

    tk, docs = Tokenizer.from_file(tokenizer_path(WORD_BPE)), docs_of(spark, data)
    start, want = 0, {}
    for d in sorted(docs):
        ids = tk.encode(docs[d], add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_records"](spark, data).collect()} == want


def test_records_by_index_and_damage(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/documents.parquet")
    folder, files = records.write_records(df, tokenizer_path(WORD_BPE), 2, str(tmp_path / "r"))
    part = files[0]["part"]
    inorder = list(records.read_at(folder, part, list(range(files[0]["records"]))))
    shuffled = random.Random(3).sample(range(files[0]["records"]), 10)
    for k, (doc, ids) in zip(shuffled, records.read_at(folder, part, shuffled)):
        assert doc == inorder[k][0] and (ids == inorder[k][1]).all()
    path = tmp_path / "r" / f"part-{part:06d}.rec"
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        list(records.read_at(folder, part, [0]))


@pytest.mark.parametrize("size", [sepscan.BLOCK, 64])
def test_separator_scan(spark, data, tmp_path, size):
    from tokenizers import Tokenizer

    tk, docs = Tokenizer.from_file(tokenizer_path(BYTE_BPE)), docs_of(spark, data)
    folder, files = sepscan.write_flat(spark.read.parquet(f"{data}/documents.parquet"), tokenizer_path(BYTE_BPE), 50256, str(tmp_path / "f"))
    start, want = 0, {}
    for d in sorted(docs):
        n = len(tk.encode(docs[d], add_special_tokens=False).ids)
        want[d] = (start, n)
        start += n + 1
    assert {r.doc_id: (r.start, r.n_tokens) for r in sepscan.scanned(spark, folder, files, 50256, size=size).collect()} == want


def test_separator_scan_of_foreign_files(spark, tmp_path):
    """Without a list of ids, with empty documents, a separator on a block's edge and an open tail."""
    ids = [9, 9, 0, 0, 9, 9, 9, 0, 9]
    (tmp_path / "part-000003.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = sepscan.scanned(spark, str(tmp_path), [{"part": 3, "ids": len(ids)}], 0, size=4).orderBy("place").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (None, 3, 0), (None, 4, 3), (None, 8, 1)]


# pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    sf = f"{data}/../sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mark = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        out = stage(spark, kept, sf)
        rows = out.collect()
        assert out.columns == docs.columns
        kept = spark.createDataFrame(rows, docs.schema).coalesce(2)
        after = {r.doc_id: r.text for r in rows}
        sizes.append(len(rows))
        if name == "near_dedup":
            ids = sorted(before)
            assert set(after) == {ids[i] for i in groups_brute([before[d] for d in ids])}
        elif name == "personal_data":
            assert set(after) == set(before) and all(("@" in before[d]) or after[d] == before[d] or re.search("[0-9]", before[d]) for d in after)
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            good = [d for d in before if mark.get(d) == 1]
            assert sum(d in after for d in good) >= 0.9 * len(good)
            assert sum(mark.get(d) == 0 for d in after) <= 0.2 * max(1, sum(mark.get(d) == 0 for d in before)) or name == "quality_rules"
    assert sizes == sorted(sizes, reverse=True)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}

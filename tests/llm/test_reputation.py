"""Hosts without outcomes inherit the bounds of their domain, suffix or the whole."""

import math

from ledgerloom.llm import urlrep

PAGES = "page_id long, url string"


def verdicts(spark, rows, hosts):
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], PAGES)
    got = urlrep.judged(pages, spark.createDataFrame(rows, "host string, bad int"), rules=()).collect()
    return {r.host: r.verdict for r in got}


def test_unseen_hosts_inherit(spark):
    """A bad and a good domain under a mixed suffix, and a suffix that is bad throughout."""
    rows = [(f"h{i}.bad.info", 1) for i in range(20) for _ in range(40)] + [("fine.bad.info", 0)] * 40 + [(f"h{i}.good.info", 0) for i in range(20) for _ in range(40)]
    rows += [(f"h{i}.d{k}.spam", 1) for i in range(3) for k in range(20) for _ in range(40)]
    got = verdicts(spark, rows, ["h1.bad.info", "new.bad.info", "bad.info", "fine.bad.info", "new.good.info", "new.other.info", "new.d1.spam", "new.unseen.spam", "new.unseen.zz", ""])
    assert got["h1.bad.info"] == got["new.bad.info"] == got["bad.info"] == got["new.d1.spam"] == got["new.unseen.spam"] == "block"
    assert got["fine.bad.info"] == got["new.good.info"] == got["new.other.info"] == got["new.unseen.zz"] == got[""] == "allow"


def test_the_whole_is_the_last_resort(spark):
    rows = [(f"h{i}.d{i}.s{i}", 1) for i in range(30) for _ in range(10)] + [("h.d.good", 0)] * 3
    assert verdicts(spark, rows, ["never.seen.zz", ""]) == {"never.seen.zz": "block", "": "block"}
    assert verdicts(spark, [], ["never.seen.zz"]) == {"never.seen.zz": "allow"}


def test_bound_of_an_unseen_host_is_that_of_its_prior(spark):
    rows = [(f"h{i}.bad.info", i % 10 != 0) for i in range(40) for _ in range(50)]
    h, d, s, w = urlrep._by_level(spark.createDataFrame([(x, int(b)) for x, b in rows], "host string, bad int"))
    assert h.count() == 40
    low = {r.domain: r._domain for r in d.collect()}["bad.info"]
    mean = 0.9
    assert abs(low - (mean - urlrep.BOUND * math.sqrt(mean * (1 - mean) / (urlrep.WEAKEST + 1)))) < 1e-6


def test_country_suffixes_are_not_one_domain(spark):
    rows = [(f"h{i}.bad.co.uk", 1) for i in range(10) for _ in range(40)] + [(f"h{i}.d{k}.co.uk", 0) for i in range(3) for k in range(12) for _ in range(40)]
    got = verdicts(spark, rows, ["new.bad.co.uk", "bad.co.uk", "new.d1.co.uk", "other.co.uk", "co.uk"])
    assert got == {"new.bad.co.uk": "block", "bad.co.uk": "block", "new.d1.co.uk": "allow", "other.co.uk": "allow", "co.uk": "allow"}


def test_sql_on_pages_of_unseen_hosts(spark, tmp_path):
    """The SQL and the query agree where hosts inherit: from a bad domain, a bad suffix, and with odd urls."""
    import duckdb

    from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

    urls, labels = [], []
    for host, bad, n in [("h1.bad.info", 1, 40), ("h2.bad.info", 1, 40), ("h3.bad.info", 1, 40), ("ok.info", 0, 90), ("a.good.de", 0, 50), *[(f"h.d{k}.spam", 1, 30) for k in range(9)], ("x.y.co.uk", 0, 30)]:
        for _ in range(n):
            labels.append((len(labels), 1 - bad, 0))
            urls.append(f"https://{host}/p/{len(labels) - 1}.html")
    urls += ["http://NEW.bad.info/a", "http://never.spam", "http://q.w.spam/x?y", "http://un.known/", "x", None, "http://z.co.uk/", "a://b.c.co.uk#f", "http://h1.bad.info/p/x"]
    spark.createDataFrame(list(enumerate(urls)), PAGES).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op5_url_filter"])
    got = QUERIES["op5_url_filter"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    verdict = {r.host: r.verdict for r in got}
    assert verdict["new.bad.info"] == verdict["never.spam"] == verdict["q.w.spam"] == "block" and verdict["un.known"] == verdict["z.co.uk"] == "allow"

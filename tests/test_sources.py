"""Sources: tree scan (two-pass, strict and lossy decode) and the ledger sink."""

import os
import tempfile

from pyspark.sql import functions as F
from conftest import SF001
from tokenloom.operators import corpus as C
from tokenloom.operators import ledger
from tokenloom.plans import domain
from tokenloom.sources import files, ledger_store


def _tree():
    d = tempfile.mkdtemp(prefix="tl-tree-", dir="/tmp")
    entries = {
        "src/app.py": b"def f():\r\n    return 1\r\n",
        "src/bad.py": b"x = '\xff\xfe'\n",
        "node_modules/lib.js": b"function g() {}\n",
        ".hidden/h.md": b"# h\n",
        "docs/.note.txt": b"hidden file is kept\n",
        "img/logo.png": b"\x89PNG",
        "README.md": b"# Title\ntext\n",
        "pkg/__init__.py": b"",
        "pkg/_priv.py": b"p = 1\n",
        "_lib/b.py": b"b = 1\n",
        "pages/[id].tsx": b"const a = 1;\n",
        "pages/i.tsx": b"const i = 1;\n",
        "pages/a b.py": b"ab = 1\n",
        "pages/100%20.py": b"c = 1\n",
    }
    for rel, data in entries.items():
        p = os.path.join(d, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    return d


def test_tree_scan_two_pass(spark):
    root = _tree()
    df = files.read_tree(spark, root, keep=C.indexable)
    got = {r.path: (r.status, r.content) for r in df.collect()}
    assert set(got) == {"src/app.py", "src/bad.py", "README.md", "docs/.note.txt", "pkg/__init__.py", "pkg/_priv.py", "_lib/b.py",
                        "pages/[id].tsx", "pages/i.tsx", "pages/a b.py", "pages/100%20.py"}
    assert got["pages/[id].tsx"][1] == "const a = 1;\n" and got["pages/i.tsx"][1] == "const i = 1;\n"
    by_uri = files.read_tree(spark, "file://" + root, keep=C.indexable)
    assert {r.path for r in by_uri.select("path").collect()} == set(got)
    pruned = files.list_tree(spark, root, enter=lambda p: ~p.startswith("pages"))
    assert pruned.filter(F.col("path").startswith("pages/")).count() == 0 and pruned.count() == 10
    assert got["src/app.py"] == ("ok", "def f():\n    return 1\n")
    assert got["src/bad.py"][0] == "undecodable"
    lossy = {r.path: r.content for r in files.read_tree(spark, root, keep=C.search_scannable, lossy=True).collect()}
    assert lossy["src/bad.py"] == "x = ''\n"
    assert "img/logo.png" not in lossy and "node_modules/lib.js" not in lossy


def test_ledger_append_and_day_pruning(spark):
    root = tempfile.mkdtemp(prefix="tl-ledger-", dir="/tmp")
    usage = domain.usage(spark, SF001)
    ledger_store.append(usage, os.path.join(root, "usage"))
    back = ledger_store.read(spark, os.path.join(root, "usage"))
    assert back.count() == usage.filter(F.col("tokens") > 0).count()
    day = back.select(F.min("day")).first()[0].isoformat()
    one = ledger_store.read(spark, os.path.join(root, "usage"), day)
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    assert one.select("day").distinct().count() == 1
    st = {r.day: r.tokens_used for r in ledger.budget_status(back, fill_days=False).collect()}
    want = {r.day: r.tokens_used for r in ledger.budget_status(usage, fill_days=False).collect()}
    assert st == want


def test_ledger_written_before_source_existed(spark):
    root = tempfile.mkdtemp(prefix="tl-ledger-", dir="/tmp")
    spark.sql("select 1L as event_id, timestamp'2024-01-01 10:00:00' as ts, 5L as tokens, 'p' as path, date'2024-01-01' as day") \
        .write.partitionBy("day").parquet(os.path.join(root, "usage"))
    r = ledger_store.read(spark, os.path.join(root, "usage")).first()
    assert r.source == "unknown" and r.tokens == 5


def test_submitted_master_is_kept():
    import subprocess
    import sys

    code = "from tokenloom.session import get_session; s = get_session(); print('MASTER', s.sparkContext.master, s.conf.get('spark.driver.memory'))"
    script = os.path.join(tempfile.mkdtemp(prefix="tl-submit-", dir="/tmp"), "job.py")
    with open(script, "w") as fh:
        fh.write(code)
    import pyspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit"), "--master", "local[2]", "--driver-memory", "2g",
                          "--conf", "spark.ui.enabled=false", script], capture_output=True, text=True, timeout=180,
                         env=os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": os.path.dirname(pyspark.__file__)})
    assert "MASTER local[2] 2g" in out.stdout, out.stderr[-500:]


def test_index_modes_and_count(spark):
    scan = spark.createDataFrame([("a.py", "x = 1", "ok"), ("b.py", None, "undecodable"), ("c.png", "", "ok")],
                                 "path string, content string, status string")
    old = C.index_rows(spark.createDataFrame([("a.py", "old", "ok"), ("gone.py", "z", "ok")], "path string, content string, status string"))
    embed = lambda c: F.array(F.length(c).cast("float"))
    up = {r.path: (r.content, r.embedding) for r in C.index_files(old, scan, embed=embed).collect()}
    assert up == {"a.py": ("x = 1", [5.0]), "gone.py": ("z", None)}
    assert {r.path for r in C.index_files(old, scan, mode="sync").collect()} == {"a.py"}
    assert tuple(C.indexed_count(scan).first()) == (1, 1, 1)


def test_counts_are_taken_on_the_write(spark, tmp_path):
    from tokenloom.operators import corpus as C

    rows = [("a.py", "x", "ok"), ("b/c.md", "y", "ok"), ("d.png", "z", "ok"), ("node_modules/e.py", "x", "ok"), ("f.txt", None, "undecodable")]
    scan = spark.createDataFrame(rows, "path string, content string, status string").repartition(3)
    got = C.write_index_rows(scan, str(tmp_path / "rows"))
    assert got == C.indexed_count(scan).first().asDict() == {"indexed": 2, "unreadable": 1, "skipped": 2}
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["a.py", "b/c.md"]
    assert C.write_index_rows(scan.limit(0), str(tmp_path / "none")) == {"indexed": 0, "unreadable": 0, "skipped": 0}


def test_files_of_any_size_have_a_digest(spark):
    import hashlib

    root = _tree()
    big = bytes(range(256)) * 20_000 + b"end"
    for name, data in (("src/big.py", big), ("src/edge.py", b"x" * 4096), ("src/over.py", b"x" * 4097)):
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(data)
    os.chmod(f"{root}/README.md", 0o000)
    hashed = {r.path: (r.length, r.content_sha, r.status) for r in files.hash_tree(spark, root).collect()}
    locked = not os.access(f"{root}/README.md", os.R_OK)
    for path, (n, sha, status) in hashed.items():
        if path == "README.md" and locked:
            assert (n, sha, status) == (None, None, "unreadable")
            continue
        with open(f"{root}/{path}", "rb") as fh:
            data = fh.read()
        assert (n, sha, status) == (len(data), hashlib.sha256(data).hexdigest(), "ok")
    assert hashed["pkg/__init__.py"][0] == 0 and len(hashed) == 17
    got = {r.path: r for r in files.read_tree(spark, root, keep=C.indexable, max_bytes=4096).collect()}
    assert got["src/edge.py"].status == "ok" and len(got["src/edge.py"].content) == 4096
    for name in ("src/big.py", "src/over.py"):
        assert (got[name].status, got[name].content, got[name].content_sha) == ("oversize", None, hashed[name][1])
    assert {r.path for r in C.index_rows(files.read_tree(spark, root, max_bytes=4096)).collect()}.isdisjoint({"src/big.py", "src/over.py"})
    parts = files.read_chunks(spark, root, keep=C.indexable, over=4096, chunk_bytes=1_000_000)
    rows = sorted(parts.collect(), key=lambda r: (r.path, r.chunk))
    assert [(r.path, r.chunk, len(r.raw)) for r in rows] == [("src/big.py", i, min(1_000_000, len(big) - i * 1_000_000)) for i in range(6)] + \
        [("src/over.py", 0, 4097)]
    assert b"".join(r.raw for r in rows if r.path == "src/big.py") == big
    assert files.read_chunks(spark, root, over=len(big)).count() == 0


def test_the_digest_holds_one_block():
    import hashlib
    import io

    asked = []

    class Blocks(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    data = b"a" * (3 * files.BLOCK + 5)
    assert files._stream(Blocks(data), 10) == (None, len(data), hashlib.sha256(data).hexdigest())
    assert set(asked) == {files.BLOCK} and files._stream(Blocks(b""), 0) == (b"", 0, hashlib.sha256(b"").hexdigest())

"""Tree listing: a literal listing, and its order at a size where partitions are sampled."""

from pyspark.sql import functions as F

from tokenloom.operators import tree as TR

PATHS = ["a/b/c.txt", "a/B.txt", "a/build/x.py", "build", "z/Zeta/q", "z/alpha", "m/", "a/b/D",
         "x/y/z/w.txt", "x/y/v/", "a/node_modules/k.js"]

LISTING = """site/
├── a
│   ├── b
│   │   ├── c.txt
│   │   └── D
│   └── B.txt
├── m
├── x
│   └── y
│       ├── v
│       └── z
│           └── w.txt
├── z
│   ├── Zeta
│   │   └── q
│   └── alpha
└── build"""


def test_listing(spark):
    df = spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in PATHS], "path string, is_dir boolean")
    got = [r.line for r in TR.listing(df, "site").orderBy("line_no").collect()]
    assert got == LISTING.split("\n")


def test_numbers_are_complete_on_many_paths(spark):
    df = spark.range(60_000).select(
        F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("string"), F.lit("/e"), (F.col("id") % 37).cast("string"),
                 F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit(False).alias("is_dir"))
    out = TR.listing(df, "site").cache()
    n, distinct, top = out.agg(F.count("line_no"), F.countDistinct("line_no"), F.max("line_no")).first()
    assert n == distinct == top + 1
    assert n == 1 + 60_000 + 40 + df.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("d")).distinct().count()
    # one last child per folder: as many closing branches at depth one as there is one root
    assert out.where(F.col("line").startswith(TR.LAST_BRANCH)).count() == 1
    order = [r.line.split("── ")[-1] for r in out.where("line_no > 0").orderBy("line_no").where(F.col("line").rlike("^[├└]")).collect()]
    assert order == sorted(order, key=str.lower)
    out.unpersist()


def _locked(names):
    """Entries of a folder, but for folders that may not be listed."""
    def entries(fs, folder):
        import pyarrow.fs as pafs

        for name, error in names.items():
            if folder.endswith(name):
                raise error
        return fs.get_file_info(pafs.FileSelector(folder))
    return entries


def test_status_of_folders_that_cannot_be_listed(spark, tmp_path):
    from tokenloom.operators import tree
    from tokenloom.sources import files

    root = tmp_path / "site"
    for name in ("b/locked/x.py", "b/open/y.py", "a.py", "node_modules/z.py", "gone/w.py", "B2/v.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    look = _locked({"/locked": PermissionError("no"), "/gone": FileNotFoundError("no")})
    found = files.tree_entries(spark, str(root), entries=look)
    status = {(r.path, r.status) for r in found.where("status <> 'ok'").collect()}
    assert status == {("b/locked", "denied"), ("gone", "missing")}
    assert sorted(r.path for r in files.list_tree(spark, str(root), entries=look).collect()) == ["B2/v.py", "a.py", "b/open/y.py", "node_modules/z.py"]
    rows = [r.line for r in tree.listing_of(found, "site").orderBy("line_no").collect()]
    assert rows == ["site/", "├── b", "│   ├── locked", "│   │   └── [Permission Denied]", "│   └── open", "│       └── y.py",
                    "├── B2", "│   └── v.py", "├── gone", "└── a.py"]


def test_roots_that_cannot_be_listed(spark, tmp_path):
    from tokenloom.operators import tree
    from tokenloom.sources import files

    bad = files.tree_entries(spark, str(tmp_path / "nothing"))
    assert [tuple(r) for r in tree.listing_of(bad, "nothing").collect()] == [(0, "# Error: nothing is not a valid directory.")]
    shut = files.tree_entries(spark, str(tmp_path), entries=_locked({str(tmp_path): PermissionError("no")}))
    assert [r.line for r in tree.listing_of(shut, "shut").orderBy("line_no").collect()] == ["shut/", "└── [Permission Denied]"]

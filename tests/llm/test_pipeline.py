import os
import subprocess
import sys

import corpus_pipeline as p
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kohort.llm.common import table
from tests.llm import test_decontaminate, test_line_dedup, test_simhash
from tests.llm.data import docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_brute_force(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("n_chars < 1500")
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    first = p.language(spark, d, sf_dir)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert first.columns == COLUMNS and len(rows) > 0.95 * d.count()

    second = p.lines(spark, first, sf_dir)
    want = {(i, t) for i, t, n, gone in test_line_dedup.brute(rows) if not gone or gone < n}
    left = [(r.doc_id, r.text) for r in second.collect()]
    assert second.columns == COLUMNS and set(left) == want and len(left) == len(want)
    assert second.filter(F.length("text") != F.col("n_chars")).count() == 0

    third = p.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], d.schema), sf_dir)
    groups = {}
    for i, _, c in test_simhash.slow_groups(left):
        groups.setdefault(c, set()).add(i)
    kept = [(r.doc_id, r.text) for r in third.collect()]
    assert third.columns == COLUMNS and sorted(i for i, _ in kept) == sorted(groups)

    fourth = p.benchmark(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in kept], d.schema), sf_dir)
    dirty = {r[0] for r in test_decontaminate.brute(kept, bench) if r[-1]}
    assert fourth.columns == COLUMNS and {r.doc_id for r in fourth.collect()} == set(groups) - dirty

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in p.encoding(spark, d.limit(50), sf_dir).join(d.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_and_empty(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() < 200 and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs(spark, []), "/root/testdata/sf0.001").count() == 0
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "kohort", "tests", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "kohort")
    for name in os.listdir(f"{root}/kohort"):
        if name != "llm":
            os.symlink(f"{root}/kohort/{name}", tmp_path / "kohort" / name)
    code = "import __spark_entry__ as e; assert 'km_by_group' in e.queries() and 'pipeline' not in e.queries()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with open(f"{root}/__spark_entry__.py") as f:  # a real copy: a link would lead back to the whole repository
        text = f.read()
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(text)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)

"""The Merkle manifest against a plain tree, and its edge cases."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Every level of a plain tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    return levels


def proof(levels, at):
    out, node = [], levels[0][at]
    sides = []
    for now in levels[:-1]:
        run = at - at % 3
        left, right = now[run:at], now[at + 1 : run + 3]
        out += left + right
        sides.append(("".join(left), "".join(right)))
        at //= 3
    return out, sides, node


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified), sorted, by whole trees in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            own, sides, node = proof(trees[s], at)
            more, over, _ = proof(top, k)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in sides + over:
                node = h(left + node + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(own + more)), node, node == top[-1][0]))
    return sorted(out, key=str)


def spark_rows(spark, rows, every=mm.EVERY):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit(1) for n in ("grp", "idx", "n", "digest", "path", "block", "claim", "name", "stage")})
    got = mm.manifest_proofs(df, mm.line_feeds_lost(), every=every).drop("path").collect()
    return sorted((tuple(r) for r in got), key=str)


def random_rows(rng, n):
    text = ["a\nb", "", None, "é ☃\n\n日本", "x" * 3000, "\r\n\t"]
    return [(i * 7 % 1000 - 20, rng.choice(["s1"] * 5 + ["s2", "é", "Z", None, ""]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(text)) for i in range(n)]


def test_equals_a_plain_tree_at_every_spacing(spark):
    rows = random_rows(random.Random(1), 300)
    want = plain(rows)
    for every in (1, 2, 5):
        assert spark_rows(spark, rows, every) == want


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (1, "a", "en", 1, "x\ny"), (1, "a", "en", 1, "x\ny"), (1, "a", "en", 2, "z"), (2, "", "de", 0, None)]
    assert spark_rows(spark, rows) == plain(rows)


def test_lone_rows_and_empty_table(spark):
    one = [(9, "a", "en", 1, "t\n")]
    assert spark_rows(spark, one) == plain(one)
    got = spark_rows(spark, one)[0]
    assert got[1] == got[2] == got[3] and got[4] == h("")
    assert spark_rows(spark, [(i, f"s{i:02}", "en", 1, "t") for i in range(40)]) == plain([(i, f"s{i:02}", "en", 1, "t") for i in range(40)])
    assert spark_rows(spark, []) == []


def test_paths_fold_to_the_root_and_only_stored_levels_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, "s", "en", i, f"text {i}") for i in range(100)], SCHEMA)
    got = mm.manifest_proofs(df, path=str(tmp_path / "m"), every=2).collect()
    assert all(r["verified"] and mm.fold(r["leaf"], r["path"]) == r["root"] for r in got)
    assert all(mm.digest(mm.siblings(r["path"])) == r["proof_sha256"] for r in got)
    assert all(mm.fold(mm.digest("other"), r["path"]) != r["root"] for r in got)
    stored = sorted(p.name for p in (tmp_path / "m" / "rows").iterdir())
    assert stored == ["leaves", "level-2", "level-4", "level-6", "places"]
    assert spark.read.parquet(str(tmp_path / "m" / "rows" / "level-2")).count() == 12


def test_very_long_text(spark):
    rows = [(i, "s", "en", 1, "é\n" * (200_000 if i == 2 else 3)) for i in range(4)]
    assert spark_rows(spark, rows) == plain(rows)

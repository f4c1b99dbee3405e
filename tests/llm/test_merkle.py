import hashlib

from pyspark.sql import functions as F

from voluma.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root of nodes, and each one's siblings (before, after) level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            first = a // 16 * 16
            ways[i].append(("".join(level[first:a]), "".join(level[a + 1 : first + 16])))
        at = [a // 16 for a in at]
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], ways


def expected(rows, claims):
    """rows: (key, group, text); claims: the text that each row is said to have."""
    order = lambda v: (v is not None, v)
    leaves = [h(*map(field, r)) for r in rows]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1], []).append(i)
    subroots, ways = {}, {}
    for g, own in groups.items():
        own.sort(key=lambda i: (order(rows[i][0]), leaves[i]))
        subroots[g], up = climb([leaves[i] for i in own])
        ways |= dict(zip(own, up))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, up = climb([subroots[g] for g in names])
    out = []
    for i, r in enumerate(rows):
        way = ways[i] + up[names.index(r[1])]
        folded = h(*map(field, (r[0], r[1], claims[i])))
        for before, after in way:
            folded = h(before, folded, after)
        out.append((r[0], leaves[i], subroots[r[1]], root, h(*[x for w in way for x in w]), folded, folded == root))
    return out


def checked(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(partitions)
    docs = docs.withColumns({"digest": F.lit(1), "at": F.lit(2), "Group": F.lit(3), "claim": F.lit("x")})
    changed = F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    got = merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "text"], {"text": changed})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    claims = [r[2].lower() if r[2] is not None and r[0] is not None and r[0] % 5 == 0 else r[2] for r in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, claims), key=key)


def test_trees_of_all_shapes(spark):
    sizes = {None: 5, "": 1, "a": 16, "b": 17, "c": 257, "é": 2, "Z": 4097}
    rows = [(i * 3 + 1, s, f"Text {i} {s}") for s, n in sizes.items() for i in range(n)]
    checked(spark, rows)


def test_groups_beyond_one_superblock(spark):
    checked(spark, [(i, "one", f"T{i}") for i in range(4096 * 2 + 33)] + [(i, f"g{i}", "x") for i in range(40)], 7)


def test_nulls_ties_and_large_keys(spark):
    big = (1 << 62) + 1
    rows = [(None, "s", "A"), (None, "s", None), (big, "s", "Ä"), (big, "s", "Ä"), (big + 1, "s", ""), (7, "s", "x" * 100_000), (7, None, "-")]
    checked(spark, rows)
    checked(spark, [(10, "only", "ABC")])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "text"]).count() == 0

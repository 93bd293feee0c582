"""The Merkle manifest against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from geofit.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, node int, i int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves):
    """Root and, for each leaf, the (left, right) siblings of every level."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            lo = at - at % 16
            path.append(("".join(nodes[lo:at]), "".join(nodes[at + 1: lo + 16])))
        nodes = [sha(*nodes[k: k + 16]) for k in range(0, len(nodes), 16)]
        places = [p // 16 for p in places]
    return nodes[0], paths


def brute(rows, changed):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        own = sha(*map(field, r[:5]))
        now = sha(*map(field, (*r[:4], r[4].lower()))) if r[0] in changed and r[4] is not None else own
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, own, now))
    subs = [(own := sorted(by[k]), climb([x[2] for x in own])) for k in sorted(by)]
    root, tops = climb([s[1][0] for s in subs])
    out = []
    for (own, (sub, paths)), above in zip(subs, tops):
        for (_, doc, leaf, now), path in zip(own, paths):
            folded = now
            for left, right in path + above:
                folded = sha(left, folded, right)
            out.append((doc, leaf, sub, root, sha(*[x for lr in path + above for x in lr]), folded, folded == root))
    return sorted(out)


def audit(spark, rows, changed):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = mm.audit(docs, F.lower("text"), F.col("doc_id").isin(*changed))
    return sorted((r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def test_manifest_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(600)]  # three levels, the last runs short
    rows += [(i, "b" * (i % 19 + 1), None, None, rng.choice(["É" * 5, "", "lower", None])) for i in range(1000, 1040)]
    rows += [(None, None, "de", 1, "A"), (2000, None, None, 2, "B"), (2001, "é", None, 2, "x" * 100_000), (2002, "one", "en", 1, "ONE")]
    rows += [(2003, "same", "en", 1, "Same")] * 3 + [(2003, "same", "en", 2, "other"), (2004, "", "", 0, "")]
    changed = {0, 17, 255, 256, 599, 1003, 2001, 2002, 2003}
    assert audit(spark, rows, changed) == brute(rows, changed)
    for few in (rows[:1], rows[:2], rows[:16], rows[:17], rows[:257], rows[600:604]):
        assert audit(spark, few, {0}) == brute(few, {0})
    assert audit(spark, [], {0}) == []


def test_a_changed_document_changes_its_root_only(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(120)]
    before = audit(spark, rows, {-1})
    after = audit(spark, [(*r[:4], "new") if r[0] == 7 else r for r in rows], {-1})
    same = [a[2] == b[2] for a, b in zip(before, after)]
    assert [r[0] % 3 != 1 for r in before] == same and before[0][3] != after[0][3]

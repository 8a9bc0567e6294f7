"""Jaccard join: rows that share an id, and members that are told apart before they are read."""

from meshweave.llm import jaccard_join


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue white black grey pink", "kilo lima mike november oscar papa")
    rows = [(3, a), (5, a), (5, b), (9, b), (10, c), (11, c), (12, c), (12, d), (4, d), (20, "x y z u v w"), (20, "x y z u v w"), (None, a), (21, None), (21, c), (30, ""), (30, None)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert found.pop(21) == {21, 4}  # a text without words links with nothing
    assert found == {3: {3}, 5: {3}, 9: {3}, 10: {4}, 11: {4}, 12: {4}, 4: {4}, 20: {20}, None: {None}, 30: {30}}


def test_a_group_that_meets_no_other_links_its_own_members(spark):
    """Three sets of one size and prefix; the first is far from the others, which link. No
    other set has a shingle of that prefix."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rare, far, near = words("rare", 43), words("far", 103), words("near", 100)
    first, second, third = (f"{rare} {rest}" for rest in (far, f"{near} x1 x2 x3", f"{near} y1 y2 y3"))
    rows = [(1, first), (2, second), (3, third)]
    # What else these texts hold is frequent, so that the prefix is of rare's shingles alone.
    for i in range(40):
        rest = (far, f"{near} x1 x2 x3", f"{near} y1 y2 y3")
        rows += [(100 + 3 * i + k, f"{words(f'own{i}x{k}y', 200)} {' '.join(rare.split()[-3:])} {rest[k]}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r["id"]: r for r in jaccard_join.prefixes(docs.selectExpr("doc_id as id", "text"), 4, 85).where("id < 100").collect()}
    assert len({(r["n"], r["p1"], r["p2"]) for r in made.values()}) == 1
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).where("doc_id < 100").collect()}
    assert got == {1: 1, 2: 2, 3: 2}

"""Concept ids, teaching moves and names against plain loops."""

from __future__ import annotations

import random

import pytest

from sigmaloom.operators import concepts


def plain_ids(bases):
    taken, last, out = set(), {}, []
    for b in bases:
        n = last.get(b, 0)
        while True:
            n += 1
            candidate = b if n == 1 else f"{b}_{n}"
            if candidate not in taken:
                break
        last[b] = n
        taken.add(candidate)
        out.append(candidate)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_skip_taken_ones(spark, seed):
    """Bases that extend others by numbers, at every depth and in every order; many corpora of one stem each."""
    r, rows, want = random.Random(seed), [], {}
    for g in range(120):
        names = [f"g{g}x", f"g{g}x_2", f"g{g}x_3", f"g{g}x_2_2", f"g{g}x_2_3", f"g{g}x_02", f"g{g}x_12", f"g{g}x_3_2_2"]
        bases = [r.choice(names[: r.randint(1, len(names))]) for _ in range(r.randint(1, 14))]
        first = len(rows)
        rows += [(first + i, b) for i, b in enumerate(bases)]
        want |= {first + i: x for i, x in enumerate(plain_ids(bases))}
    r.shuffle(rows)
    got = {x.n: x.concept_id for x in concepts.unique_concept_ids(spark.createDataFrame(rows, "n long, b string"), "b", "n").collect()}
    assert got == want and len(set(got.values())) == len(got)
    plain = concepts.unique_concept_ids(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2")], "n long, b string"), "b", "n").sort("n").collect()
    assert [x.concept_id for x in plain] == ["a", "a_2", "a_2_2"]


def test_teaching_moves(spark):
    texts = [
        "It is so. Recalling 2.1 suggests this. An estimator.", "No. We estimate it, where x is y.", "Where it is defined as z! Then.", "The so-called one is called it.", "Let us begin. x $$ where $$ y.",
        "A where clause.", "Plain words only. And more.", None, "  ", "Somewhere else, elsewhere. " + "long " * 100,
    ]
    got = {r.id: (r.move, r.sentence) for r in concepts.teaching_move(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    moves = [m for m, _ in concepts.MOVES]
    assert [got[i][0] for i in range(7)] == [*moves, concepts.NO_MOVE] and set(got) == {0, 1, 2, 3, 4, 5, 6, 9}
    assert got[0][1] == "Recalling 2.1 suggests this." and got[4][1] == "Let us begin." and got[9] == (concepts.NO_MOVE, "Somewhere else, elsewhere.")


def test_concept_names(spark):
    rules = [("^c$", "(?i)recombination", "Recombination Rate", "quantity_concept"), ("^c$", "(?i)control", "Control Population", "domain_concept")]
    names = spark.createDataFrame([("w", "Fitness"), ("\\Delta p", "Change of p")], "symbol string, name string")
    f = spark.createDataFrame([("f1", "Under recombination and control. The mean is defined as the ordinary value of it here."), ("f2", "Here the genetic load is given. The cost of selection by L equals one."), ("f3", None), ("f4", "A control only.")], "formula_id string, context_text string")
    occ = [("f1", "c", False), ("f4", "c", True), ("f3", "c", False), ("f1", r"\overline{w}", True), ("f1", "w", False), ("f2", "L", True), ("f2", r"\beta_{2}", False), ("f3", r"\sum", False), ("f3", r"\mathbf{G}", False), ("f3", "Var", False), ("f3", r"x_{i}", True)]
    d = spark.createDataFrame(occ, "formula_id string, symbol string, defines boolean")
    got = {r.key: (r.name, r.concept_type, r.conf, r.needs_review) for r in concepts.symbol_concepts(d, f, rules, names, spark.createDataFrame([("f2::L",)], "key string")).collect()}
    assert got["f1::c"] == ("Recombination Rate", "quantity_concept", 84, False) and got["f4::c"][:2] == ("Control Population", "domain_concept") and got["f4::c"][2] == 95
    assert got["f3::c"] == ("C", "domain_concept", 68, True)
    assert got["f1::\\overline{w}"][:2] == ("Mean Fitness", "quantity_concept") and got["f1::w"][0] == "Fitness"
    assert got["f2::L"][:2] == ("Genetic Load", "quantity_concept") and got["f2::\\beta_{2}"][0] == "Beta"
    assert got["f3::\\sum"][:2] == ("Sum", "operator_or_function") and got["f3::\\mathbf{G}"][0] == "G Matrix" and got["f3::Var"][1] == "math_concept" and got["f3::x_{i}"] == ("X Sub I", "quantity_concept", 87, False)
    assert len(got) == len(occ)

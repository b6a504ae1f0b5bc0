"""Networks of the families against their published sigma polynomials, the generators of parameters, and the dataset."""

import re

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import families as fam
from skeinwork.operators import kernels

# Family, parameters and sigma polynomial, as published.
GOLDEN = """
periodic_theta (1,) 0
periodic_theta (2,) s^3 - s^2 + s
periodic_theta (3,) s^5 - 4*s^4 + 8*s^3 - 9*s^2 + 4*s
periodic_theta (4,) s^7 - 5*s^6 + 15*s^5 - 29*s^4 + 40*s^3 - 32*s^2 + 11*s
periodic_theta (5,) s^9 - 6*s^8 + 21*s^7 - 51*s^6 + 94*s^5 - 135*s^4 + 140*s^3 - 90*s^2 + 26*s
periodic_theta (6,) s^11 - 7*s^10 + 28*s^9 - 78*s^8 + 168*s^7 - 292*s^6 + 421*s^5 - 487*s^4 + 417*s^3 - 227*s^2 + 57*s
periodic_theta (7,) s^13 - 8*s^12 + 36*s^11 - 113*s^10 + 274*s^9 - 540*s^8 + 895*s^7 - 1274*s^6 + 1547*s^5 - 1533*s^4 + 1134*s^3 - 539*s^2 + 120*s
periodic_theta (8,) s^15 - 9*s^14 + 45*s^13 - 157*s^12 + 423*s^11 - 927*s^10 + 1711*s^9 - 2725*s^8 + 3816*s^7 - 4720*s^6 + 5056*s^5 - 4440*s^4 + 2914*s^3 - 1234*s^2 + 247*s
periodic_theta (9,) s^17 - 10*s^16 + 55*s^15 - 211*s^14 + 625*s^13 - 1507*s^12 + 3061*s^11 - 5365*s^10 + 8270*s^9 - 11391*s^8 + 14154*s^7 - 15786*s^6 + 15324*s^5 - 12174*s^4 + 7212*s^3 - 2760*s^2 + 502*s
periodic_theta (10,) s^19 - 11*s^18 + 66*s^17 - 276*s^16 + 891*s^15 - 2343*s^14 + 5193*s^13 - 9933*s^12 + 16698*s^11 - 25046*s^10 + 33979*s^9 - 42149*s^8 + 47954*s^7 - 49334*s^6 + 44120*s^5 - 32132*s^4 + 17387*s^3 - 6077*s^2 + 1013*s
sierpinski (2, 1) 0
sierpinski (3, 1) s
sierpinski (4, 1) s^3 - 3*s^2 + 2*s
sierpinski (2, 2) 0
sierpinski (5, 1) -s^6 + 4*s^5 - 10*s^4 + 15*s^3 - 15*s^2 + 6*s
sierpinski (6, 1) -s^10 + 5*s^9 - 15*s^8 + 35*s^7 - 64*s^6 + 96*s^5 - 120*s^4 + 120*s^3 - 80*s^2 + 24*s
sierpinski (3, 2) -s^4 + 3*s^3 - 3*s^2 + s
sierpinski (2, 3) 0
sierpinski (7, 1) s^15 - 6*s^14 + 21*s^13 - 56*s^12 + 126*s^11 - 245*s^10 + 420*s^9 - 645*s^8 + 895*s^7 - 1120*s^6 + 1260*s^5 - 1225*s^4 + 945*s^3 - 490*s^2 + 120*s
sierpinski (8, 1) s^21 - 7*s^20 + 28*s^19 - 84*s^18 + 210*s^17 - 462*s^16 + 916*s^15 - 1660*s^14 + 2779*s^13 - 4333*s^12 + 6328*s^11 - 8680*s^10 + 11200*s^9 - 13600*s^8 + 15464*s^7 - 16261*s^6 + 15400*s^5 - 12495*s^4 + 7980*s^3 - 3444*s^2 + 720*s
complete_graph (1,) -1
complete_graph (2,) 0
complete_graph (3,) s
complete_graph (4,) s^3 - 3*s^2 + 2*s
complete_graph (5,) -s^6 + 4*s^5 - 10*s^4 + 15*s^3 - 15*s^2 + 6*s
complete_graph (6,) -s^10 + 5*s^9 - 15*s^8 + 35*s^7 - 64*s^6 + 96*s^5 - 120*s^4 + 120*s^3 - 80*s^2 + 24*s
complete_graph (7,) s^15 - 6*s^14 + 21*s^13 - 56*s^12 + 126*s^11 - 245*s^10 + 420*s^9 - 645*s^8 + 895*s^7 - 1120*s^6 + 1260*s^5 - 1225*s^4 + 945*s^3 - 490*s^2 + 120*s
complete_graph (8,) s^21 - 7*s^20 + 28*s^19 - 84*s^18 + 210*s^17 - 462*s^16 + 916*s^15 - 1660*s^14 + 2779*s^13 - 4333*s^12 + 6328*s^11 - 8680*s^10 + 11200*s^9 - 13600*s^8 + 15464*s^7 - 16261*s^6 + 15400*s^5 - 12495*s^4 + 7980*s^3 - 3444*s^2 + 720*s
complete_graph (9,) -s^28 + 8*s^27 - 36*s^26 + 120*s^25 - 330*s^24 + 792*s^23 - 1716*s^22 + 3423*s^21 - 6363*s^20 + 11116*s^19 - 18368*s^18 + 28854*s^17 - 43260*s^16 + 62076*s^15 - 85428*s^14 + 112917*s^13 - 143493*s^12 + 175308*s^11 - 205660*s^10 + 231014*s^9 - 246918*s^8 + 248136*s^7 - 229887*s^6 + 190260*s^5 - 133749*s^4 + 73612*s^3 - 27468*s^2 + 5040*s
complete_graph (10,) -s^36 + 9*s^35 - 45*s^34 + 165*s^33 - 495*s^32 + 1287*s^31 - 3003*s^30 + 6435*s^29 - 12860*s^28 + 24220*s^27 - 43308*s^26 + 73932*s^25 - 121020*s^24 + 190620*s^23 - 289740*s^22 + 425964*s^21 - 606816*s^20 + 838880*s^19 - 1126720*s^18 + 1471680*s^17 - 1870560*s^16 + 2314320*s^15 - 2787120*s^14 + 3265710*s^13 - 3718764*s^12 + 4106172*s^11 - 4379144*s^10 + 4482190*s^9 - 4359300*s^8 + 3969168*s^7 - 3310272*s^6 + 2447760*s^5 - 1527120*s^4 + 743120*s^3 - 245664*s^2 + 40320*s
complete_bipartite (1, 1) 0
complete_bipartite (1, 2) 0
complete_bipartite (2, 2) s
complete_bipartite (1, 3) 0
complete_bipartite (2, 3) -s^2 + s
complete_bipartite (1, 4) 0
complete_bipartite (3, 3) -s^4 + 5*s^3 - 9*s^2 + 5*s
complete_bipartite (2, 4) s^3 - s^2 + s
complete_bipartite (1, 5) 0
complete_bipartite (3, 4) -s^6 + 6*s^5 - 17*s^4 + 29*s^3 - 30*s^2 + 13*s
complete_multipartite (1, 1) 0
complete_multipartite (2, 1) 0
complete_multipartite (1, 1, 1) s
complete_multipartite (2, 2) s
complete_multipartite (3, 1) 0
complete_multipartite (2, 1, 1) -s^2 + s
complete_multipartite (1, 1, 1, 1) s^3 - 3*s^2 + 2*s
complete_multipartite (3, 2) -s^2 + s
complete_multipartite (4, 1) 0
complete_multipartite (2, 2, 1) -s^4 + 4*s^3 - 6*s^2 + 3*s
fan (2,) s
fan (3,) -s^2 + s
fan (4,) s^3 - 2*s^2 + s
fan (5,) -s^4 + 3*s^3 - 3*s^2 + s
fan (6,) s^5 - 4*s^4 + 6*s^3 - 4*s^2 + s
fan (7,) -s^6 + 5*s^5 - 10*s^4 + 10*s^3 - 5*s^2 + s
fan (8,) s^7 - 6*s^6 + 15*s^5 - 20*s^4 + 15*s^3 - 6*s^2 + s
fan (9,) -s^8 + 7*s^7 - 21*s^6 + 35*s^5 - 35*s^4 + 21*s^3 - 7*s^2 + s
fan (10,) s^9 - 8*s^8 + 28*s^7 - 56*s^6 + 70*s^5 - 56*s^4 + 28*s^3 - 8*s^2 + s
fan (11,) -s^10 + 9*s^9 - 36*s^8 + 84*s^7 - 126*s^6 + 126*s^5 - 84*s^4 + 36*s^3 - 9*s^2 + s
wheel (3,) s^3 - 3*s^2 + 2*s
wheel (4,) -s^4 + 4*s^3 - 6*s^2 + 3*s
wheel (5,) s^5 - 5*s^4 + 10*s^3 - 10*s^2 + 4*s
wheel (6,) -s^6 + 6*s^5 - 15*s^4 + 20*s^3 - 15*s^2 + 5*s
wheel (7,) s^7 - 7*s^6 + 21*s^5 - 35*s^4 + 35*s^3 - 21*s^2 + 6*s
wheel (8,) -s^8 + 8*s^7 - 28*s^6 + 56*s^5 - 70*s^4 + 56*s^3 - 28*s^2 + 7*s
wheel (9,) s^9 - 9*s^8 + 36*s^7 - 84*s^6 + 126*s^5 - 126*s^4 + 84*s^3 - 36*s^2 + 8*s
wheel (10,) -s^10 + 10*s^9 - 45*s^8 + 120*s^7 - 210*s^6 + 252*s^5 - 210*s^4 + 120*s^3 - 45*s^2 + 9*s
wheel (11,) s^11 - 11*s^10 + 55*s^9 - 165*s^8 + 330*s^7 - 462*s^6 + 462*s^5 - 330*s^4 + 165*s^3 - 55*s^2 + 10*s
wheel (12,) -s^12 + 12*s^11 - 66*s^10 + 220*s^9 - 495*s^8 + 792*s^7 - 924*s^6 + 792*s^5 - 495*s^4 + 220*s^3 - 66*s^2 + 11*s
ladder (2,) s
ladder (3,) -s^2 + s
ladder (4,) s^3 - 2*s^2 + s
ladder (5,) -s^4 + 3*s^3 - 3*s^2 + s
ladder (6,) s^5 - 4*s^4 + 6*s^3 - 4*s^2 + s
ladder (7,) -s^6 + 5*s^5 - 10*s^4 + 10*s^3 - 5*s^2 + s
ladder (8,) s^7 - 6*s^6 + 15*s^5 - 20*s^4 + 15*s^3 - 6*s^2 + s
ladder (9,) -s^8 + 7*s^7 - 21*s^6 + 35*s^5 - 35*s^4 + 21*s^3 - 7*s^2 + s
ladder (10,) s^9 - 8*s^8 + 28*s^7 - 56*s^6 + 70*s^5 - 56*s^4 + 28*s^3 - 8*s^2 + s
ladder (11,) -s^10 + 9*s^9 - 36*s^8 + 84*s^7 - 126*s^6 + 126*s^5 - 84*s^4 + 36*s^3 - 9*s^2 + s
circular_ladder (3,) -s^4 + 5*s^3 - 8*s^2 + 4*s
circular_ladder (4,) s^5 - 7*s^4 + 20*s^3 - 25*s^2 + 11*s
circular_ladder (5,) -s^6 + 9*s^5 - 35*s^4 + 70*s^3 - 69*s^2 + 26*s
circular_ladder (6,) s^7 - 11*s^6 + 54*s^5 - 145*s^4 + 220*s^3 - 176*s^2 + 57*s
circular_ladder (7,) -s^8 + 13*s^7 - 77*s^6 + 259*s^5 - 525*s^4 + 637*s^3 - 426*s^2 + 120*s
circular_ladder (8,) s^9 - 15*s^8 + 104*s^7 - 420*s^6 + 1064*s^5 - 1722*s^4 + 1736*s^3 - 995*s^2 + 247*s
circular_ladder (9,) -s^10 + 17*s^9 - 135*s^8 + 636*s^7 - 1932*s^6 + 3906*s^5 - 5250*s^4 + 4524*s^3 - 2267*s^2 + 502*s
"""


def golden():
    out = []
    for line in GOLDEN.strip().split("\n"):
        name, params, said = re.fullmatch(r"(\w+) (\([^)]*\)) (.*)", line).groups()
        terms = {}
        for sign, c, s, e in re.findall(r"([+-]?) ?(\d*)\*?(s?)\^?(\d*)(?: |$)", said.replace("- ", "-").replace("+ ", "+")):
            if c or s:
                terms[int(e or 1) if s else 0] = (-1 if sign == "-" else 1) * int(c or 1)
        out.append((name, tuple(int(x) for x in re.findall(r"\d+", params)), {k: v for k, v in terms.items() if v}))
    return out


def test_golden_polynomials(spark):
    """All published rows: the edges come from the operators, by their parameters."""
    rows, want = None, {}
    for name in {n for n, *_ in golden()}:
        mine = [(p, poly) for n, p, poly in golden() if n == name]
        want |= {(name, str(list(p))): poly for p, poly in mine}
        if name == "complete_multipartite":
            e = fam.multipartite(spark.createDataFrame([(list(p),) for p, _ in mine], "sizes array<int>")).select(F.col("sizes").alias("p"), "u", "v")
        else:
            two = len(mine[0][0]) == 2
            e = fam.edges(spark.createDataFrame([(p[0], p[1] if two else 0) for p, _ in mine], "a int, b int"), name)
            e = e.select((F.array("a", "b") if two else F.array("a")).alias("p"), "u", "v")
        e = e.select(F.lit(name).alias("name"), "p", "u", "v")
        rows = e if rows is None else rows.unionByName(e)
    graphs = {}
    for r in rows.collect():
        graphs.setdefault((r["name"], str(r["p"])), []).append((r["u"], r["v"]))
    assert len(want) == 87
    for key, poly in want.items():
        pairs = graphs.get(key, [])
        ids = {x: i for i, x in enumerate(sorted({x for e in pairs for x in e}))}
        # networks without edges have one vertex here, as complete_graph (1,)
        assert kernels.sigma_polynomial(max(1, len(ids)), [(ids[u], ids[v]) for u, v in pairs]) == poly, key


# The first parameters of each family's sweep.
FIRST = {
    "periodic_theta": "(1,) (2,) (3,)", "sierpinski": "(2, 1) (3, 1) (4, 1)", "complete_graph": "(1,) (2,) (3,)", "complete_bipartite": "(1, 1) (1, 2) (2, 2)",
    "complete_multipartite": "(1, 1) (2, 1) (1, 1, 1)", "fan": "(2,) (3,) (4,)", "wheel": "(3,) (4,) (5,)", "ladder": "(2,) (3,) (4,)", "circular_ladder": "(3,) (4,) (5,)",
    "grid": "(1, 1) (1, 2) (2, 1)", "cylinder": "(2, 2) (2, 3) (3, 2)", "hypercube": "(1,) (2,) (3,)", "friendship": "(1,) (2,) (3,)", "windmill": "(3, 2) (3, 3) (4, 2)",
    "circulant": "(4, (1,)) (4, (2,)) (4, (1, 2))", "generalized_petersen": "(5, 1) (5, 2) (6, 1)", "mobius_ladder": "(2,) (3,) (4,)",
}


@pytest.mark.parametrize("count", [3, 10])
def test_sweeps(spark, count):
    got: dict = {}
    for r in sorted(fam.sweeps(spark, count).collect(), key=lambda r: (r["family"], r["rank"])):
        got.setdefault(r["family"], []).append(r["params"])
    assert sorted(got) == sorted(FIRST) and all(" ".join(got[k][:3]) == v for k, v in FIRST.items())
    assert all(len(v) == count for v in got.values())
    named = {}
    for n, p, _ in golden():
        named.setdefault(n, set()).add(str(p))
    assert all(p in fam_rows for n, fam_rows in ((n, set(got[n])) for n in named) for p in named[n]) or count < 10


def test_dataset_sink(spark, tmp_path):
    from skeinwork.sources import dataset

    rows = fam.sweeps(spark, 4)
    for kind in ("csv", "parquet"):
        path = dataset.write(rows.select("family", "params"), f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, dataset.read(spark, path, kind).collect())) == sorted(map(tuple, rows.select("family", "params").collect()))

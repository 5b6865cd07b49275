from karwan.llm import brands as B

NAMES = [("Vrenokas & Vamar", 1), ("ڤرينوكاس و ڤامار", 1), ("Maqawal", 2), ("Maqowal", 3), ("Gold Klisasa", 4), ("كليساسا الذهبي", 4), ("Klinaza", 5), ("Zwashalet", 6), (None, 7), ("", 8), ("Gold Plonifin", 9), ("Gold Fazoqa", 10)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, en string, ar string, old string, value string")
    return B.assign(df, ["en", "ar", "old"], spark.createDataFrame(NAMES, "name string, id int"))


def test_values(spark):
    cases = {
        "vrenokas vamar": 1, "VRENOKAS && VAMAR Ltd": 1, "vrenoks & vmar": 1, "ڤرينكاس و ڤامار للأغذية": 1, "Klisasa, Gold": 4, "G O L D K L I S A S A": 4, "<b>Klinaza</b>®": 5, "Кlinаzа": 5, "/klinaza_1": 5,
        "brand: Zwashlaet": 6, "kl1naza": 5, "Klinaza - كلينازا": 5, "Zwashalet Chicken Breast": 6, "N/A": 0, "-": 0, "Unbranded": 0, "Finom": 0, "Fidon Gold": 0, "x" * 50_000: 0, "y " * 3000: 0, "maqawal": 2, "maqowal": 3,
    }
    mapped, unmatched = run(spark, [(i, v, None, None, "clash") for i, v in enumerate(cases)])
    got = {r.record_id: r.canonical_id for r in mapped.collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert {r.value for r in unmatched.collect()} == {v for v, c in cases.items() if c == 0}


def test_order_of_fields_ties_and_blanks(spark):
    rows = [(1, "nothing", "Klinaza", "maqawal", ""), (2, " ", None, "", ""), (3, None, None, None, ""), (4, "maqwal", "Maqowal", None, ""), (5, "maqwal", None, None, ""), (6, None, "zwashalet", "klinaza", ""), (6, None, "zwashalet", "klinaza", ""), (None, "klinaza", None, None, "")]
    got = {(r.record_id, r.canonical_id) for r in run(spark, rows)[0].collect()}
    assert {(1, 5), (4, 3), (6, 6)} <= got and {r[0] for r in got} == {1, 4, 5, 6}
    assert dict(got)[5] in (2, 3)


def test_pigeonhole_join_finds_all_near_names(spark):
    import random

    rng = random.Random(8)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 11))) for _ in range(40)]
    values = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 12))) for _ in range(120)]

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    k = lambda n: next((e for most, e in B.EDITS if n <= most), B.MOST_EDITS)
    want = {(v, i) for v in values for i, n in enumerate(names) if 0 < k(len(n)) >= lev(v, n)}
    m = B.Matcher(spark.createDataFrame([(v, 1) for v in set(values)], "value string, n long"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int"))
    w = spark.createDataFrame([(v, v, "", "", True) for v in set(values)], "value string, key string, pre string, suf string, usual boolean")
    assert {(r.value, r.id) for r in m.near(w).collect()} == want


def test_empty(spark):
    mapped, unmatched = run(spark, [])
    assert mapped.collect() == [] and unmatched.collect() == []
    df = spark.createDataFrame([(1, "a", None, None, None)], "id long, en string, ar string, old string, value string")
    mapped, _ = B.assign(df, ["en", "ar", "old"], spark.createDataFrame([], "name string, id int"))
    assert [tuple(r) for r in mapped.collect()] == [(1, 0)]

from sparvex.llm.leakage import Items, leaked_items, search_batch, words_of

OPEN = "Answer the following question with one single number only."
ITEMS = [
    (1, f"{OPEN} Every winter the glonin engine loses 609 units of zokerm unless a miller refills the tower by 17 noon."),
    (2, f"{OPEN} A clerk stores 334 stinims in a crimson cellar then moves 989 of them to the bodrem vault today."),
    (3, f"{OPEN} Between 202 and 370 godands pass the golden orchard before the silent clerk closes it again."),
    (4, f"{OPEN.upper()} EVERY WINTER THE GLONIN ENGINE LOSES 609 UNITS OF ZOKERM UNLESS A MILLER REFILLS THE TOWER BY 17 NOON"),
    (5, "What is 7 times 8?"), (6, None), (7, "  "), (None, "x " * 30),
    (8, "def fun_zoki(zoki, traf=83):\n    nomun = [traf * q - 15 for q in zoki if q % 55]\n    return sorted(nomun, key=lambda z: z ^ 246)"),
]
P1 = "Every winter the glonin engine loses 609 units of zokerm unless a miller refills the tower"


def found(text):
    items = Items([(i, t) for i, t in ITEMS if i and t])
    return {k for _, k in search_batch(items, [None, text, ""], {})}


def test_spellings_that_do_not_count():
    assert found(f"bla bla {P1} bla") == {1, 4}
    assert found(P1.upper().replace(" ", "  **") + "**") == {1, 4}
    assert found("# " + P1.replace(" ", "&nbsp;").replace("engine", "<i>engine</i>")) == {1, 4}
    assert found('"source": ["' + P1.replace(" the ", '\\n", \n    "the ') + '"]') == {1, 4}
    assert found("# " + "\n# ".join(P1.split())) == {1, 4}
    assert found("z = '''def fun_zoki(zoki, traf=83):\\n    nomun = [traf * q - 15 for q in zoki if q % 55]'''") == {8}


def test_edits_and_lengths():
    w = P1.split()
    assert found(" ".join(w[2:14])) == {1, 4} and found(" ".join(w[2:13])) == set()
    assert found(" ".join([*w[:5], "other", *w[6:14]])) == {1, 4}
    assert found(" ".join([*w[:5], *w[6:14]])) == {1, 4}
    assert found(" ".join([*w[:5], "very", *w[5:14]])) == {1, 4}
    assert found(" ".join([*w[2:5], "a", *w[6:9], "b", *w[10:14]])) == set()
    assert found(OPEN) == set() and found(OPEN + " " + OPEN) == set()
    assert found(" ".join(w[:7]) + "\n# %% [markdown]\n# " + " ".join(w[7:])) == set()


def test_long_text_and_foreign_letters():
    assert found("تم ئ ─ " * 30_000 + P1 + " é" * 30_000) == {1, 4}
    assert words_of("P\\u00e8sent naïve") == ["pèsent", "naïve"]


def test_table(spark):
    docs = [(1, P1, "x"), (1, P1, "x"), (2, None, None), (3, "", None), (4, "nothing here", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    assert sorted(map(tuple, leaked_items(d, e).collect())) == [(1, 1), (1, 4)]
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0


def test_items_that_share_their_text():
    """Many items on one passage: no run of it is rare, and each of them leaks."""
    words = P1.split()
    items = [(i, f"Number{i} asks about this: {P1}. Which of them holds, {i} or {i + 1}?") for i in range(30)]
    edited = " ".join([*words[:5], "other", *words[6:12]])
    assert {k for _, k in search_batch(Items(items), [f"x y {edited} z"], {})} == set(range(30))
    assert not list(search_batch(Items(items), [" ".join(words[:11])], {}))


def test_any_passage_with_two_edits_is_found():
    words = [f"w{i}" for i in range(16)]
    items = Items([(1, " ".join(words))])

    for a in range(1, 15):
        for b in range(a + 1, 15):
            for one in ((), ("n",)):
                text = " ".join([*words[:a], *one, *words[a + 1 : b], "k", *words[b + 1 :]])
                assert list(search_batch(items, [text], {})) == [(0, 1)], text


def test_openings_are_shared_over_blocks(spark, monkeypatch):
    import sparvex.llm.leakage as L

    monkeypatch.setattr(L, "ITEMS_AT_ONCE", 1)
    opening = "Read the short story below with care and then answer the one question that follows it in few words"
    rows = [(i, f"{opening}. " + " ".join(f"q{i}x{j}" for j in range(14))) for i in range(4)]
    d = spark.createDataFrame([(1, opening), (2, rows[2][1])], "doc_id long, text string")
    e = spark.createDataFrame(rows, "item_id long, item_text string")
    assert sorted(map(tuple, leaked_items(d, e).collect())) == [(2, 2)]
    # two items that share it are enough; one scan whatever the number of blocks
    found = leaked_items(d, e.where("item_id in (1, 2)"))
    assert sorted(map(tuple, found.collect())) == [(2, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def dynamic_programme(doc, item):
    """Any passage of at least 12 words that begins and ends with equal words, with at most one edit in eight: all
    beginnings, all lengths, full edit distances of what is between."""
    for b in range(len(item)):
        for a in range(len(doc)):
            if doc[a] != item[b]:
                continue
            row = list(range(len(doc) - a))
            for n, w in enumerate(item[b + 1 :], 2):
                if n >= 12 and any(row[i] * 8 <= n and doc[a + 1 + i] == w for i in range(len(row) - 1)):
                    return True
                new = [n - 1]
                for i, x in enumerate(doc[a + 1 :], 1):
                    new.append(min(row[i - 1] + (x != w), row[i] + 1, new[-1] + 1))
                row = new
    return False


def test_search_equals_a_full_dynamic_programme():
    import random

    random.seed(8)
    item = [f"w{random.randint(0, 25)}" for _ in range(60)]
    items = Items([(1, " ".join(item))])
    seen = []
    for _ in range(250):
        a = random.randint(0, 30)
        part = item[a : a + random.randint(9, 50)]
        for _ in range(random.randint(0, 7)):
            i = random.randrange(len(part))
            part[i : i + 1] = random.choice([[], [f"x{i}"], [part[i], "y"], [f"w{random.randint(0, 25)}"]])
        doc = [*random.choices(item, k=3), *part, *random.choices(["z", "w1", "w2"], k=4)]
        want = dynamic_programme(doc, item)
        seen.append(want)
        assert [k for _, k in search_batch(items, [" ".join(doc)], {})] == [1] * want, (part, want)
    assert 50 < sum(seen) < 220

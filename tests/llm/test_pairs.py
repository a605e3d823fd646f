from skein.llm import pairs


def build(n=60):
    """Sound pairs about many people and topics, and one of each defect."""
    topics = ["garden fence", "budget review", "piano lessons", "visa papers", "school trip", "logo draft"]
    rows = []
    for i in range(n):
        name, t = f"Nor{chr(97 + i % 26)}vel{chr(97 + i // 26)}ki", topics[i % 6]
        q = f"what did {name} say about the {t}"
        rows.append((i, q, [["lex", f"{name} the {t} notes"], ["vec", f"written summary of {name}'s position on the {t}"], ["vec", f"open questions {name} raised about the {t}"], ["hyde", f"{name} wrote that the {t} should be settled soon."]]))
    for i in range(n // 3):
        name, t = f"Fra{chr(97 + i)}belo", ["clôture du jardin", "lettre de visa"][i % 2]
        rows.append((500 + i, f"qu'a dit {name} sur la {t}", [["lex", f"message {name} la {t}"], ["vec", f"résumé écrit de la position de {name} sur la {t}"], ["hyde", f"{name} a écrit que la {t} est pour les amis."]]))
    q = "what did Zorbalek say about the garden fence"
    rows += [
        (900, q, None), (901, q, []), (902, q, [["lex", "..."], ["vec", None], None]),
        (910, q, [["lex", q.upper() + "?"], ["vec", "Question: " + q]]),
        (920, q, [["lex", "Sorry, I cannot help with that request."], ["vec", "Sorry, I cannot help with that request."]]),
        (921, "what did Wolbarek say about the piano lessons", [["hyde", "Sorry, I cannot help with that request."]]),
        (930, q, [["lex", "Zorbalek the garden fence notes"], ["vec", "open questions Zorbalek raised about the"]]),
        (931, q, [["lex", "Zorbalek the garden fence notes"], ["hyde", "Zorbalek wrote that the garden fence shou"]]),
        (932, q, [["vec", "open questions Zorbalek raised about the gard"]]),
        (940, q, [["lex", "Zorbalek the garden fence notes"], ["vec", "résumé écrit de la position de Zorbalek sur la clôture du jardin"]]),
        (950, q, [["lex", q], ["vec", "open questions Zorbalek raised about the garden fence"]]),
        (951, q, [["hyde", "Zorbalek is sorry to be unable to help with the garden fence before May."]]),
        (952, None, [["lex", "Zorbalek the garden fence notes"]]),
    ]
    return rows


def test_each_defect(spark):
    df = spark.createDataFrame([(*r, 1) for r in build()], "record_id long, query string, output array<array<string>>, kinds int")
    df = df.union(df.where("record_id = 930"))
    got = {r["record_id"]: r["defect"] for r in pairs.defective_pairs(pairs.read_pairs(df, "t", "output", lines=False)).collect()}
    assert got == {900: "empty", 901: "empty", 902: "empty", 910: "copied_question", 920: "refusal", 921: "refusal", 930: "truncated", 931: "truncated", 932: "truncated", 940: "other_language"}


def test_lines():
    assert pairs.parse_lines("<think>\n\n</think>\n\n- LEX: a\r\nvec： b") == ([("lex", "a"), ("vec", "b")], False)
    assert pairs.parse_lines("lex: a\nhy")[1] and pairs.parse_lines("lex: a\nvec:")[1]
    assert pairs.parse_lines("lex:\nvec:") == ([("lex", ""), ("vec", "")], False)
    assert pairs.parse_lines(None) == ([], False) and pairs.parse_lines("free text") == ([("text", "free text")], False)


def test_minhash_neighbours_are_verified(spark):
    base = "i am sorry but i cannot help you with this particular request today"
    texts = [base, base + " ok", "a completely different opening about quite other things in life", "short one"]
    df = spark.createDataFrame([(t,) for t in texts], "opening string")
    near = {(r["a"], r["b"]) for r in pairs.similar_openings(df).collect()}
    assert near == {tuple(sorted((base, base + " ok")))}


def _refusals(spark, rows):
    df = spark.createDataFrame(build() + rows, "record_id long, query string, output array<array<string>>")
    return {r["record_id"] for r in pairs.defective_pairs(pairs.read_pairs(df, "t", "output", lines=False)).where("defect = 'refusal'").collect()}


def test_an_answer_of_its_own_is_no_refusal(spark):
    """Shares nothing with its prompt and ends in a stop, once, or again for the same prompt."""
    own = [["hyde", "They settled everything over coffee last Tuesday, and nobody minded the long discussion at all."]]
    q = "when does Morvelki want to fix the garden fence"
    assert not {970, 971} & _refusals(spark, [(970, q, own), (971, q, own)])


def test_variants_of_a_refusal_meet(spark):
    rows = [
        (980, "call Norbaki regarding the garden fence", [["hyde", "Unfortunately, my rules forbid expansions about private persons."]]),
        (981, "email from Zelmiki about piano lessons", [["lex", "Sorry, but my rules forbid expansions about private persons. Ask somebody else instead."]]),
        (982, "visa papers of Traloki", [["vec", "Leider kann ich dabei wirklich nicht helfen."]]),
        (983, "school trip of Bramoki", [["vec", "Kann ich dabei wirklich nicht helfen."]]),
        (984, "logo draft by Kelmoki", [["vec", "Thank you for asking. Everything was settled over coffee last Tuesday evening."]]),
        (985, "school trip by Velmoki", [["vec", "Thank you for asking. The bus leaves at eight from behind the station."]]),
    ]
    assert _refusals(spark, rows) & set(range(980, 990)) == {980, 981, 982, 983}


def test_sound_answers_without_the_prompts_words(spark):
    same = [["hyde", "They live for ten years in clean water with company."]]
    rows = [
        (990, "what did Zorbalek say about the garden fence", [["hyde", "He wanted it painted green before the summer."]]),
        (991, "pet life span", [["hyde", "Goldfish live for ten years in a clean tank."]]),
        (992, "lifespan of goldfish indoors", same),
        (993, "goldfish lifespan outside", same),
    ]
    assert not {990, 991, 992, 993} & _refusals(spark, rows)


def test_a_large_band_stays_connected(spark, monkeypatch):
    from skein.operators.curation import components

    monkeypatch.setattr(pairs, "BAND", 5)
    texts = [f"i am sorry but i cannot help you with this particular request about the private person today for reasons of policy {chr(97 + i)}x" for i in range(26)]
    df = spark.createDataFrame([(t,) for t in texts], "opening string")
    roots = components(pairs.similar_openings(df)).collect()
    assert {r["node"] for r in roots} == set(texts) and len({r["root"] for r in roots}) == 1


def test_a_large_band_drops_no_pair(spark, monkeypatch):
    """One band of all texts, in which the like of each is far from it in order and no other one is similar."""
    monkeypatch.setattr(pairs, "BAND", 5)
    tail = [f"t{k}" for k in range(40)]
    text = lambda front, i: " ".join([f"{front}{i}", *tail[: 6 + i % 30], f"v{i}", *tail[7 + i % 30 :]])
    texts = [text(front, i) for i in range(60) for front in "az"]
    similar = lambda x, y: len(x & y) / len(x | y) >= pairs.SIMILAR
    want = {(min(x, y), max(x, y)) for n, x in enumerate(texts) for y in texts[:n] if similar(pairs._shingles(x), pairs._shingles(y))}
    assert want == {(text("a", i), text("z", i)) for i in range(60)}
    near = {(r["a"], r["b"]) for r in pairs.similar_openings(spark.createDataFrame([(t,) for t in texts], "opening string"), bands=1, rows=1).collect()}
    assert near <= want and len(near) >= 50


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, query string, output array<array<string>>")
    assert pairs.defective_pairs(pairs.read_pairs(df, "t", "output", lines=False)).count() == 0

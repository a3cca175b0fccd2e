"""Cases in which an operator once did less than the whole job."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t in rows], DOCS)


def test_pipeline_drops_copies_at_five_words_and_80_percent(spark):
    import corpus_pipeline
    from tissueloom.llm.jaccard import link_components

    words = [f"w{k}" for k in range(52)]  # one word changed: 43 of 53 five-word shingles, 45 of 53 four-word ones
    docs = docs_frame(spark, [(1, " ".join(words)), (2, " ".join([*words[:26], "other", *words[27:]])), (3, " ".join(words[::-1]))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]
    assert {r["component_id"] for r in link_components(docs).collect()} == {1, 2, 3}


def test_quality_bands_part_labelled_junk_from_clean_texts(spark):
    from tissueloom.llm.quality import accepted, judge_quality, keep_good

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = judge_quality(docs)
    seen = verdict.where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    junk, clean = ([r["kept"] for r in seen if r["quality"] == q] for q in (0, 1))
    assert sum(junk) < 0.5 * len(junk) and sum(clean) > 0.97 * len(clean)
    kept = keep_good(docs)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in verdict.where("kept").collect())
    # short texts are judged on characters per token and fallback
    assert not accepted("LATIN", 20, 1.1, 0.0, 3.0) and not accepted("LATIN", 20, 3.0, 0.5, 3.0) and accepted("LATIN", 20, 3.0, 0.0, 3.0)


def test_hard_wrapped_passages_are_removed(spark):
    from tissueloom.llm.lines import remove_repeats

    words = [f"w{k}" for k in range(65)]
    wrapped = "\n".join(" ".join(words[k : k + 13]) for k in range(0, 65, 13))
    mixed = "\n".join(" ".join(w) for w in (words[:14], words[14:32], words[32:45], words[45:]))  # 14, 18, 13 and 20 words
    same = "\n".join(["one short line"] * 18)
    docs = docs_frame(spark, [(1, f"a b\n{wrapped}\nc"), (2, f"d e f\n{wrapped}\ng h"), (3, f"i\n\n{mixed}"), (4, f"{mixed}\nj k"), (5, same), (6, "heading\na short line\n\nb"), (7, "heading\na short line\n\nc")])
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "d e f\ng h" and got[2]["n_removed"] == 1
    assert got[3]["n_removed"] == 0 and got[4]["text"] == "j k"
    assert got[5]["text"] == "\n".join(["one short line"] * 6) + "\n" and got[7]["n_removed"] == 0
    assert all(r["kept_chars"] + r["removed_chars"] == n["n_chars"] for r, n in ((got[x["doc_id"]], x) for x in docs.collect()))


def test_quality_keeps_rows_by_text_whatever_their_ids(spark):
    from tissueloom.llm.quality import judge_quality, keep_good

    good = "The committee met on Tuesday to discuss the harbour wall and nobody could agree on who should pay for it."
    rows = [(1, good, "en"), (1, good, "en"), (None, good, None), (2, "too short", "en"), (2, good + " Twice.", ""), (None, None, "en"), (3, "again and " * 40, "en")]
    docs = spark.createDataFrame([(i, t, lang, f"row{k}") for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, _digest string").repartition(3)
    kept = keep_good(docs)
    assert kept.schema == docs.schema and sorted(r["_digest"] for r in kept.collect()) == ["row0", "row1", "row2", "row4"]
    assert judge_quality(docs).where("kept").count() == 4


def test_passages_inside_lines_are_removed(spark):
    from tissueloom.llm.lines import remove_repeats

    said = " ".join(f"{a} {b} {c} stood on the hill." for a, b, c in zip("abcdefgh", "ijklmnop", "qrstuvwx"))  # 56 words
    docs = docs_frame(spark, [(1, f"Before. {said} After it."), (2, f"Other words here! {said.upper()} and more words.\nEnd."), (3, f"Cut off {said}"), (4, "a i q stood on the hill. Alone.")])
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "Other words here! and more words.\nEnd."
    # the first sentence differs by what stands before it
    assert got[3]["text"] == "Cut off a i q stood on the hill. " and got[4]["n_removed"] == 0
    assert [docs.where(f"doc_id = {k}").first()["text"][slice(*map(int, got[k]["spans"].split(":")))] for k in (2, 3)] == [said.upper() + " ", said[len("a i q stood on the hill. ") :]]


def test_licence_grants_and_tags_are_labelled(spark):
    from tissueloom.llm.licenses import scan_licenses

    found = {
        1: ("Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software", "mit"),
        2: ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided", "bsd"),
        3: ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "isc"),
        4: ("// SPDX-License-Identifier: Apache-2.0", "apache"),
        5: ("BSD 3-Clause License", "bsd"),
        6: ("permission is granted, free of charge, to any person obtaining a copy", ""),
    }
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in scan_licenses(docs_frame(spark, [(k, t) for k, (t, _) in found.items()])).collect()}
    assert got == {k: (label, "") for k, (_, label) in found.items()}


def test_spelled_addresses_of_letters_only(spark):
    from tissueloom.llm.pii import find_pii, redacted

    spelled = ["jane.doe (at) example (dot) org", "jane [at] example.org", "bob at example dot com", "Bob (AT) Example (DOT) Org"]
    rows = [(k, f"write to {s} today") for k, s in enumerate(spelled)] + [(10, f"since 2019 {spelled[0]} today"), (11, "we met at noon and sat at the wall"), (12, "jane (at) home now")]
    docs = docs_frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in find_pii(docs).collect()}
    assert got == {k: f"email:9:{9 + len(s)}" for k, s in enumerate(spelled)} | {10: f"email:11:{11 + len(spelled[0])}", 11: "", 12: ""}
    assert {r["text"] for r in redacted(docs).where("doc_id < 4").collect()} == {"write to <EMAIL> today"}


def test_typed_declarations_and_long_literals():
    from tissueloom.llm.secrets import added_spans, literal_score, pairs

    typed = ['password: str = "Zx81!kQp02Lm"', 'let api_key: &str = "Zx81!kQp02Lm"', 'const apiKey: string = "Zx81!kQp02Lm"', 'var token string = "Zx81!kQp02Lm"', 'db_pwd: Optional[str] = "Zx81!kQp02Lm"']
    for t in typed:
        (begin, end, _), = added_spans(t, [], 4.0)
        assert t[begin:end] == t.removeprefix("let ").removeprefix("const ").removeprefix("var ")
    assert [x[:2] for x in pairs("password: QWxhZGRpbg==\nname: K\nx = 3")] == [("password", "QWxhZGRpbg=="), ("name", "K"), ("x", "3")]
    # white space after the first 4096 characters counts
    (_, value, *_, counts), = pairs(f'secret_a = "{"a1B!c" * 1000} and prose"')
    assert len(value) == 4096 and sum(counts.values()) == 5010 and literal_score(value, counts) == -5.0


def test_names_and_literals_side_by_side():
    from tissueloom.llm.secrets import added_spans, base_spans

    found = {
        "<password>Zx81!kQp02Lm</password>": "password>Zx81!kQp02Lm",
        'conn.put("api_key", "Zx81kQp02LmAA")': 'api_key", "Zx81kQp02LmAA',
        "cfg.setPassword('Zx81!kQp02Lm')": "Password('Zx81!kQp02Lm",
        "a: 1\nsecret_key: |\n  Zx81kQp02LmAA99\n  more": "secret_key: |\n  Zx81kQp02LmAA99",
        "<b>bold</b> and <user>bob</user>": None,
        'they said "token", "hello world again"': None,
        "notes: |\n  Zx81kQp02LmAA99": None,
    }
    for text, want in found.items():
        assert [text[b:e] for b, e, _ in added_spans(text, base_spans(text), 4.0)] == ([want] if want else []), text


def test_every_labelled_segment_is_a_candidate():
    from tissueloom.llm.pii import candidates, islands, training_lines

    kinds = set()
    for line, gold in training_lines(600, 11):
        known = {(isl.tokens[i][0], isl.tokens[j - 1][1], kind) for isl in islands(line) for i, j, kind, _ in candidates(isl, 24)}
        assert set(gold) <= known, (line, set(gold) - known)
        kinds |= {k for _, _, k in gold}
    assert kinds == {"email", "ip", "card", "phone"}


def test_numbers_that_are_no_phones(spark):
    from tissueloom.llm.pii import find_pii

    docs = docs_frame(spark, [(1, "id 123-45-6789 of 2024"), (2, "tel 555-123-4567 please")])
    assert {r["doc_id"]: r["spans"] for r in find_pii(docs).collect()} == {1: "", 2: "phone:4:16"}

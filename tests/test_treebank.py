"""Treebank words against a table made by hand, and the ends of sentences."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ragstone.functions import treebank
from ragstone.operators import lexical

#: one sentence each
WORDS = [
    ("Good muffins cost $3.88 in New York.", "Good muffins cost $ 3.88 in New York ."),
    ("They'll save and invest more.", "They 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ("It is 3.14, or 1,000.5 or 10:30", "It is 3.14 , or 1,000.5 or 10:30"),
    ("the U.S. economy", "the U.S. economy"),
    ("a state-of-the-art plan", "a state-of-the-art plan"),
    ("well... yes", "well ... yes"),
    ("I cannot go", "I can not go"),
    ("gimme that, I'm gonna lemme", "gim me that , I 'm gon na lem me"),
    ("I wanna go", "I wan na go"),
    ("'Tis the season", "'T is the season"),
    ("'twas late", "'t was late"),
    ("d'ye see", "d 'ye see"),
    ("more'n that", "more 'n that"),
    ('She said "yes" twice.', "She said `` yes '' twice ."),
    ('"Quoted"', "`` Quoted ''"),
    ('("in brackets")', "( `` in brackets '' )"),
    ("Bob's dogs' toys", "Bob 's dogs ' toys"),
    ("I'd've gone", "I'd 've gone"),
    ("WE'LL DON'T", "WE 'LL DO N'T"),
    ("5% of A&B; see #3 @home", "5 % of A & B ; see # 3 @ home"),
    ("(a) [b] {c} <d>", "( a ) [ b ] { c } < d >"),
    ("a--b", "a -- b"),
    ("Really?! No!", "Really ? ! No !"),
    ("ends with etc.", "ends with etc ."),
    ('He said "no."', "He said `` no . ''"),
    ("(It ended.)", "( It ended . )"),
    ("key: value", "key : value"),
    ("at 5:", "at 5 :"),
    ("don't", "do n't"),
    ("isn't it", "is n't it"),
    ("one  two\tthree\nfour", "one two three four"),
    ("", ""),
    ("   ", ""),
    (".", "."),
    ("a", "a"),
    ("e.g. this", "e.g. this"),
    ("Mr. Smith", "Mr. Smith"),
    ("v1.2.3", "v1.2.3"),
    ("x,y", "x , y"),
    ("1,2", "1,2"),
    ("and/or", "and/or"),
    ("über-gut façade", "über-gut façade"),
    ("cost: $5", "cost : $ 5"),
    ("[see p.7]", "[ see p.7 ]"),
    ("100%", "100 %"),
    ("what's that", "what 's that"),
    ("they're we've", "they 're we 've"),
    ("I got gotta", "I got got ta"),
    ("scannot", "scannot"),
]
#: texts with the abbreviations dr, inc and e.g
SENTENCES = [
    ("It ended. It began.", "It ended .|It began ."),
    ("See Dr. Smith. Then go.", "See Dr. Smith .|Then go ."),
    ("Acme Inc. grew. Others (e.g. Foo) fell.", "Acme Inc. grew .|Others ( e.g. Foo ) fell ."),
    ("J. Doe came. He left.", "J. Doe came .|He left ."),
    ("What? Yes! Fine.", "What ?|Yes !|Fine ."),
    ('He said "go." Then he left.', "He said `` go . ''|Then he left ."),
    ("wait... then go.", "wait ... then go ."),
    ("Ask Dr.", "Ask Dr ."),
    ("lower case too. it ends here. 3.5 stays.", "lower case too .|it ends here .|3.5 stays ."),
    ("one\n\ntwo.\nthree", "one two .|three"),
]


def test_words_by_hand(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS)], "i int, t string")
    got = {r["i"]: " ".join(r["w"]) for r in rows.select("i", treebank.treebank(F.col("t")).alias("w")).collect()}
    assert {WORDS[i][0]: w for i, w in got.items()} == dict(WORDS)


def test_sentences_by_hand(spark):
    known = ["dr", "inc", "e.g"]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, t string")
    got = rows.select("i", treebank.treebank_words(F.col("t"), known).alias("w"), treebank.sentences(F.col("t"), known).alias("s")).collect()
    for r in got:
        text, want = SENTENCES[r["i"]]
        assert " ".join(r["w"]) == want.replace("|", " ") and len(r["s"]) == want.count("|") + 1, text
    none = spark.createDataFrame([(None,)], "t string").select(treebank.treebank_words(F.col("t")).alias("w"), treebank.sentences(F.col("t")).alias("s")).collect()[0]
    assert none["w"] == [] and none["s"] == []
    with pytest.raises(ValueError):
        treebank.sentences(F.col("t"), map(str, range(treebank.MOST + 1)))


def test_abbreviations_are_learnt(spark):
    plain = "The company said it was fine. A fine company grew in the year. In a year so much is done by noon. Nobody at noon said so. "
    texts = [plain + f"Then Dr. Foo of Acme Inc. met Mr. Bar, e.g. at noon. Number {i} is done." for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    got = {r["token"]: (r["n"], r["with_stop"]) for r in treebank.abbreviations(docs).collect()}
    assert set(got) >= {"dr", "inc", "mr", "e.g"} and got["dr"] == (60, 60) and not set(got) & {"fine", "said", "year", "company", "done"}
    assert treebank.abbreviations(docs.limit(0)).count() == 0 and treebank.abbreviations(spark.createDataFrame([("no stops here",)], "text string")).count() == 0


def test_words_as_a_tokeniser_of_the_index(spark):
    docs = spark.createDataFrame([(1, "Rates of 3.14% rose."), (2, "Rates of 3 and 14 fell."), (3, "I cannot say.")], "id long, text string")
    own = lambda c: treebank.treebank_words(F.lower(c))
    got = lexical.bm25_topk(spark.createDataFrame([(1, "3.14"), (2, "not")], "id long, text string"), docs, 5, tokenize=own).collect()
    assert {(r["query_id"], r["corpus_id"]) for r in got} == {(1, 1), (2, 3)}

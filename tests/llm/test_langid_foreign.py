"""Texts in languages that the table doesn't label are not accepted."""

import pytest

from lignum.llm import langid

FOREIGN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق",
    "人人生而自由，在尊严和权利上一律平等。", "すべての人間は、生まれながらにして自由であり", "모든 인간은 태어날 때부터 자유로우며", "सभी मनुष्यों को गौरव और अधिकारों के मामले में",
    "\U0001f600\U0001f601 \U0001f602", "xqzv kjhw pfft zzgk wqrx vbnm jklq", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności",
]


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], None])
def test_foreign_texts_go(spark, docs, langs):
    given = docs.select("doc_id", "text", "lang").filter(docs.lang.isin(langs) if langs else "true")
    planted = spark.createDataFrame([(10**9 + k, t * 3, None) for k, t in enumerate(FOREIGN)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.keep_identified(given.unionByName(planted)).select("doc_id").collect()}
    assert [t for k, t in enumerate(FOREIGN) if 10**9 + k in kept] == []
    assert len(kept) >= 0.99 * given.filter("length(trim(text)) > 0").count()


def test_other_scripts_are_told_apart():
    texts = [("Все люди рождаются свободными и равными в своём достоинстве", "ru"), ("Усі люди народжуються вільними і рівними у своїй гідності", "uk")]
    model = langid.train(texts * 4)
    got = langid.label_texts(model, [t for t, _ in texts]).to_pylist()
    assert [r["label"] for r in got] == ["ru", "uk"] and all(r["recognised"] for r in got)

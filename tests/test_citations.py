"""Citations: laws, cited items, and the places of references."""

import pytest

from concordia.operators import citations as c

TEXT = "213 sayılı Vergi Usul Kanununun 23 üncü, geçici 19 ve 20 nci maddeleri ile Gelir Vergisi Kanununun 94 üncü maddesinin 1 inci fıkrası; aynı Kanunun 638-642 nci maddelerinde. 2772 sayılı Kanunla değişik 24/2 nci maddesi, KVK'nın yirmi üçüncü maddesi ve madde 37 uygulanır. 2007/13033 sayılı Kararın 5 inci maddesi."


def test_laws():
    found = [(x.number, x.written, x.amending, x.decree) for x in c.laws_of(TEXT)]
    assert found[:3] == [("213", True, False, False), ("193", True, False, False), ("193", False, False, False)]
    assert ("2772", True, True, False) in found and ("5520", True, False, False) in found and any(x[3] for x in found)


def test_citations():
    got = [(x.articles, x.ranges) for x in c.citations_of(TEXT)]
    assert got[0] == (("23", "geçici 19", "geçici 20"), ())
    assert got[1] == (("94",), ()) and got[2] == (("638 ila 642",), ((638, 642),)) and got[3] == (("24",), ())
    assert got[4] == (("23",), ()) and got[5] == (("37",), ())


def best(number, name, madde, text=TEXT):
    found = c.places(text, number, name, madde)
    return text[found[0].start : found[0].end] if found else None


def test_places():
    assert best("213", "", "23").startswith("213 sayılı Vergi Usul Kanununun 23")
    assert best("", "GVK", "94") == "Gelir Vergisi Kanununun 94 üncü maddesinin"
    assert best("193", "", "640") == "aynı Kanunun 638-642 nci maddelerinde"
    assert best("213", "", "geçici 20") is not None and best("213", "", "99") is None
    assert best("5520", "", "23").endswith("yirmi üçüncü maddesi")
    assert best("193", "", "23") is None or "yirmi" not in best("193", "", "23")
    assert best("213", "", "") == "213 sayılı Vergi Usul Kanununun"
    # the number of the law that amends owns no article
    assert [p.law for p in c.places(TEXT, "2772", "", "24")] == [3]


@pytest.mark.parametrize("words,value", [("birinci", 1), ("on ikinci", 12), ("onikinci", 12), ("otuz dokuzuncu", 39), ("yirminci", 20), ("sonuncu", None), ("elli", None)])
def test_ordinals(words, value):
    assert c.ordinal(words) == value


def test_agreement():
    law = c.Law(0, 1, "", "katmadegervergisikanunu")
    assert c.agrees(law, "3065", "degervergisikanunu") is True and c.agrees(law, "3065", "gelirvergisikanunu") is None
    assert c.agrees(law._replace(number="193"), "3065", "") is False


def test_attached(spark):
    rows = spark.createDataFrame([(1, 0, "213", "", "23", "", TEXT), (1, 1, "213", "", "99", "", TEXT), (1, 2, "1", "", "1", "kept", TEXT), (2, 0, "193", "", "5", "", None)], "doc_id long, pos long, law_no string, law_name string, article string, source_text string, text string")
    placed, refused = c.attached(rows)
    got = {(r.doc_id, r.pos): r.quotes for r in placed.collect()}
    assert got.keys() == {(1, 0), (1, 2)} and got[1, 2] == ["kept"] and got[1, 0][0].startswith("213 sayılı")
    assert {(r.doc_id, r.pos) for r in refused.collect()} == {(1, 1), (2, 0)}

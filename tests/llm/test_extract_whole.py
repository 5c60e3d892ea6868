"""Article text that has to survive: other languages, and excluded elements without an end tag."""

import pytest

from sprachwerk.llm.extract import main_text

CZECH = [
    "Vláda dnes schválila návrh zákona, který upravuje pravidla pronájmu bytů ve velkých městech, a předloží jej parlamentu příští týden.",
    "Opozice kritizuje, že návrh nebyl předem projednán s obcemi ani s odborníky, kteří upozorňují na nedostatek nových staveb.",
]


def test_a_page_in_another_language_has_its_text():
    page = f"<body><ul><li><a href=/>Domů</a><li><a href=/z>Zprávy</a></ul><h1>Nový zákon</h1><p>{CZECH[0]}</p><p>{CZECH[1]}</p><div><a href=/k>Kontakt</a></div></body>"
    text = main_text(page)
    assert all(x in text for x in CZECH)
    assert "Kontakt" not in text and "Domů" not in text


def test_few_function_words_still_rule_out_where_the_language_is_known():
    prose = "The council said that it will be open to all of the people who have been in the town for more than a year, and that they can ask for help at the office if they want to do so. " * 2
    junk = "Winter jackets, leather boots, wool scarves, silk ties, cotton shirts, denim trousers, summer dresses, sports shoes"
    assert main_text(f"<p>{prose}</p><p>{junk}</p>") == " ".join(prose.split())


@pytest.mark.parametrize(
    "page",
    [
        "<main><p class=notice>gone<p>kept</main>",
        "<main><p class=notice>gone<div>kept</div></main>",
        "<main><ul><li class=share>gone<p>gone<li>kept</ul></main>",
        "<main><ul><li class=share>gone<ul><li>gone<li>gone</ul>gone</ul><p>kept</main>",
        "<main><ul><li class=share>gone<div>gone</div></li></ul><p>kept</main>",
        "<main><table><tr><td class=sidebar>gone<p>gone<td>kept</table></main>",
        "<main><table><tr><td class=sidebar>gone<table><tr><td>gone<tr><td>gone</table>gone<tr><td>kept</table></main>",
        "<main><dl><dd class=share>gone<dt>kept</dl></main>",
        "<main><div><p class=notice>gone</div>kept</main>",
        "<main><p class=notice>gone <b>gone</b></p>kept</main>",
        "<main><div class=ad>gone<p>gone<div>gone</div>gone</div>kept</main>",
    ],
)
def test_an_excluded_element_ends_where_html_ends_it(page):
    assert main_text(page) == "kept"

import pytest
from pyspark.sql import functions as F

from biblioflow.functions import dates, filename, genres, isbn, language, markup, scoring, series, text
from biblioflow.sources import payloads


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


L = F.lit
NO = lambda: F.lit(None).cast("string")


def test_clean_text(value):
    assert value(text.clean_text(L("<p>a&nbsp;b</p>\n\n\n<b>c</b> &amp;lt; <br/>d"))) == "a b\n\nc <\nd"
    assert value(text.clean_text(L(" <i> </i>"))) is None and value(text.clean_text(NO())) is None


def test_edition_noise(value):
    for title in ("Fuego (Edición especial)", "Fuego - Spanish Edition", "Fuego: Edición ilustrada", "Fuego Kindle Edition", "Fuego (Spanish Edition) (Kindle Edition)", "Fuego edición en español"):
        assert value(text.strip_edition_noise(L(title))) == "Fuego", title
    assert value(text.strip_edition_noise(L("La edición perdida"))) == "La edición perdida"


def test_normal_forms(value):
    assert value(text.normalize_text(L("  Ñandú, ¡Él! ø"))) == "nandu el"
    assert value(text.normalize_text(L("Café"))) == "cafe" and value(text.normalize_text(NO())) == ""
    assert value(text.slugify(L("El Río – 2"))) == "el-rio-2"
    assert value(text.normalize_file_name(L(" Él  (1).EPUB"))) == "el (1).epub"
    assert not value(text.is_meaningful(L("Sin Título"))) and not value(text.is_meaningful(L("N/A"))) and value(text.is_meaningful(L("It")))


def test_similarity(value):
    assert value(text.title_similarity(L("Fantástica"), L("La fantastica"))) == 0.92
    assert value(text.title_similarity(L("abc"), L("abc def"))) == 0.5
    assert value(text.title_similarity(L("É"), L("e"))) == 1 and value(text.title_similarity(NO(), L("e"))) == 0
    assert value(text.author_similarity(L("Ana Ruiz"), L("Luis Ruiz"))) == 0.78
    assert value(text.word_similarity(L("el la"), L("los las"))) == 0


@pytest.mark.parametrize("title", ["A oscuras (Adéntrate en la oscuridad 1)", "A oscuras (Adéntrate en la oscuridad #1)", "A oscuras (Adéntrate en la oscuridad, 1)", "A oscuras (Adéntrate en la oscuridad 1 de 3)"])
def test_structured_title(value, title):
    assert tuple(value(series.structured_title(L(title)))) == ("A oscuras", "Adéntrate en la oscuridad", "1")


def test_structured_title_forms(value):
    assert tuple(value(series.structured_title(L("Saga Vol. 2: El fin")))) == ("El fin", "Saga", "2")
    assert tuple(value(series.structured_title(L("Saga 03 - El fin")))) == ("El fin", "Saga", "3")
    assert value(series.structured_title(L("Título (Edición especial)"))) is None and value(series.structured_title(L("Saga #0: Fin"))) is None


def test_series_index(value):
    got = [value(series.normalize_series_index(L(x))) for x in ("01", "1,5", "-1", "x", " 7.0 ", "")]
    assert got == ["1", "1.5", None, None, "7", None]
    assert value(series.same_series_index(L("01"), L("1.0"))) and not value(series.same_series_index(NO(), NO()))


def test_isbn(value):
    assert value(isbn.normalize_isbn(L("978-0-306-40615-7"))) == "9780306406157" and value(isbn.normalize_isbn(L("9780306406158"))) is None
    assert value(isbn.normalize_isbn(L("0-8044-2957-x"))) == "080442957X" and value(isbn.normalize_isbn(NO())) is None
    assert value(isbn.best_isbn(F.array(L("080442957X"), L("9780306406157")))) == "9780306406157" and value(isbn.best_isbn(F.array(L("x")))) is None


def test_dates(value):
    for d, ok in (("2024-02-30", False), ("2024-02-29", True), ("1999", True), ("0999", False), ("2024-01-01T10:00", False), ("2024-13", False), ("2030", False)):
        assert value(dates.plausible_publication_date(L(d), 2026)) == ok, d
    for d, out in (("March 5, 2010", "2010-03-05"), ("c1963", None), ("published 1963", "1963"), ("2016-04", "2016-04"), ("0101-01-01", None), ("2024-01-02T10:00:00Z", "2024-01-02")):
        assert value(dates.normalize_publication_date(L(d), 2026)) == out, d
    assert value(dates.epoch_millis_date(L(1_700_000_000_000))) == "2023-11-14"


def test_language(value):
    assert value(language.is_spanish(L("/languages/spa"))) and not value(language.is_spanish(NO()))
    assert value(language.language_code(L("/languages/ger"))) == "de" and value(language.language_matches(L("es"), NO()))
    assert value(language.looks_spanish(L("the el and la y"))) and not value(language.looks_spanish(L("the end"))) and value(language.looks_spanish(L("año")))


def test_file_names(value):
    def read(name):
        return [(h.kind, h.origin, h.confidence, h.hints.title, h.hints.author, h.hints.series, h.hints.series_index) for h in value(filename.file_name_hypotheses(L(name)))]

    assert read("1984.epub") == [("title", "filename-full", 0.84, "1984", None, None, None)]
    assert read("Area_51.epub") == [("title", "filename-full", 0.84, "Area 51", None, None, None), ("series", "filename-series-ambiguous", 0.35, None, None, "Area", "51")]
    assert read("The Girl - Who Lived.epub") == [("title", "filename-split", 0.9, "The Girl", "Who Lived", None, None), ("title", "filename-full", 0.84, "The Girl - Who Lived", None, None, None)]
    assert read("Saga Vol. 2 - Ana Ruiz.epub")[0] == ("series", "filename-series-explicit", 0.99, None, "Ana Ruiz", "Saga", "2")
    assert {h[2] for h in read("Saga Vol. 2 - Ana Ruiz.epub")[1:]} == {0.35}
    assert value(filename.safe_file_name(L("a/b\\c"))) == "a_b_c.epub" and value(filename.safe_file_name(L("  "))) == "book.epub"
    assert value(filename.device_file_name(L(".."))) is None
    long = value(filename.canonical_file_name(L("x" * 300), L("Ana"), L("o.epub"), series.structured_title(L("x"))))
    assert long.sync_title == "x" * 174 or len(long.file_name) <= 185


def test_scores(value):
    want = {"title": L("El Faro"), "author": L("Ana Ruiz"), "language": L("es"), "series": L("Saga"), "series_index": L("2")}
    have = want | {"description": L("x")}
    assert value(scoring.title_score(want, have)) == 100 and value(scoring.series_score(want, have)) == 100
    assert value(scoring.weighted(L(95), L(0.94))) == 94
    assert value(scoring.title_score(want, have | {"author": L("Bo Li")})) == 65 + 3 + 2 - 25
    assert value(scoring.title_score(want | {"author": NO()}, have)) == 100
    assert value(scoring.series_score(want, have | {"series_index": L("3")})) == 0


def test_genres(value):
    got = [value(genres.translate_genre(L(x))) for x in ("Fantasy", "enemies-to-lovers", "kindle", "to-read", "Poesía", " ")]
    assert got == ["Fantasía", "Enemies To Lovers", None, "to-read", "Poesía", None]


OPF = """<package xmlns:dc="x"><metadata><dc:title>El &amp; <i>faro</i></dc:title><dc:creator>Ana</dc:creator><dc:identifier>uuid:1</dc:identifier><dc:identifier>urn:isbn:978-0-306-40615-7</dc:identifier>
<dc:subject>Terror</dc:subject><dc:subject> </dc:subject><dc:date>2010-02</dc:date><meta content="Saga" name="calibre:series"/><meta name="calibre:series_index" content="2"/></metadata></package>"""


def test_package(value):
    m = value(markup.package_metadata(L(OPF), 2026))
    assert (m.title, m.author, m.isbn, m.published, m.series, m.series_index, m.subjects, m.description) == ("El & faro", "Ana", "9780306406157", "2010-02", "Saga", "2", ["Terror"], None)
    new = markup.rewrite_package(OPF, {"title": "A<b", "publisher": "P"}, ["x", "X", "y"])
    m = value(markup.package_metadata(L(new), 2026))
    assert (m.title, m.publisher, m.subjects) == ("A<b", "P", ["x", "y"])
    with pytest.raises(ValueError):
        markup.rewrite_package("<a/>", {"title": "x"})


def test_page(value):
    page = """<div id="title"><h1>El faro</h1></div><div id='autor'><a href="x">Ana&#241;</a></div><div id="serie"><span class="a tagTitle">Libro 1,5 de:</span><a>Saga</a></div>
    <div id="genero"><a>Terror</a><a>Terror</a><a>Humor</a></div><div id="sinopsis">uno<br>dos <script>x</script>&ntilde;</div>"""
    m = value(markup.page_metadata(L(page)))
    assert (m.title, m.author, m.series, m.series_index, m.subjects, m.description) == ("El faro", "Anañ", "Saga", "1.5", ["Terror", "Humor"], "uno\ndos ñ")
    assert value(markup.is_challenge(L("<title>Just a moment...</title>"))) and not value(markup.is_challenge(L(page)))
    assert value(markup.links(L('<a href="/book/1"><a href="/x"><a href="/book/1"><a href="/book/2"><a href="/book/3">'), "^/book/")) == ["/book/1", "/book/2"]
    assert value(markup.last_event(L('data: {"status":"working"}\ndata: {bad\r\ndata: {"status":"done","n":1}\ndata: {"status":"working"}'))) == '{"status":"done","n":1}'


def test_payloads(value):
    v = '{"volumeInfo":{"title":"El faro","authors":["Ana","Bo"],"industryIdentifiers":[{"type":"ISBN_10","identifier":"080442957X"},{"type":"ISBN_13","identifier":"9780306406157"}],"pageCount":10,"seriesInfo":{"bookDisplayNumber":"n. 2,5"},"categories":[" a ",""]}}'
    m = value(payloads.volume_metadata(L(v), 2026))
    assert (m.title, m.author, m.isbn, m.page_count, m.series_index, m.subjects) == ("El faro", "Ana", "9780306406157", 10.0, "2.5", ["a"])
    e = '{"title":"F","isbn_13":["9780306406157"],"languages":[{"key":"/languages/spa"}],"number_of_pages":0,"publish_date":"2001"}'
    m = value(payloads.edition_metadata(L(e), L("9780306406157"), 2026))
    assert (m.language, m.page_count, m.published) == ("es", None, "2001") and value(payloads.edition_metadata(L(e), L("080442957X"), 2026)) is None
    assert value(payloads.work_id(L("/works/OL12W"))) == "OL12W" and value(payloads.work_id(L("/works/x"))) is None
    page = """<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Book","name":"El faro (Spanish Edition)","author":[{"name":"Ana"}],"inLanguage":"Spanish","numberOfPages":12}]</script>"""
    m = value(payloads.linked_data_metadata(L(page)))
    assert (m.title, m.author, m.language, m.page_count) == ("El faro", "Ana", "es", 12.0)


def test_state_graph(value):
    g = """{"ROOT_QUERY":{"getBookByLegacyId({\\"legacyId\\":\\"7\\"})":{"__ref":"Book:a"}},"Book:b":{"title":"Otro"},
    "Book:a":{"title":"El faro","legacyId":7,"primaryContributorEdge":{"role":"Translator","node":{"__ref":"C:1"}},"secondaryContributorEdges":[{"role":"Author","node":{"__ref":"C:2"}}],
    "bookSeries":[{"userPosition":"2","series":{"__ref":"S:1"}}],"bookGenres":[{"genre":{"name":"Fantasy"}},{"genre":{"name":"kindle"}}],"details":{"publicationTime":1700000000000,"isbn13":"9780306406157","language":{"name":"Spanish"},"numPages":9}},
    "C:1":{"name":"T"},"C:2":{"name":"Ana"},"S:1":{"title":"Saga"}}"""
    m = value(payloads.state_graph_metadata(L(g), L("7"), 2026))
    assert (m.title, m.author, m.series, m.series_index, m.subjects, m.published, m.isbn, m.language, m.page_count) == ("El faro", "Ana", "Saga", "2", ["Fantasía"], "2023-11-14", "9780306406157", "es", 9.0)
    assert value(payloads.state_graph_metadata(L('{"x":{}}'), L("7"), 2026)) is None

"""Language ID and quality: held-out accuracy, method properties, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import language, quality

SF = "/root/testdata/sf0.01"
#: Below this many rows a quarter or a third is too few to judge.
DOC = "doc_id long, text string, lang string, source string, score string"


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = language.query(spark, SF).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert 0.15 < len(held) / len(out) < 0.35
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_kernel_is_the_presence_kernel():
    texts = ["Hello there", "hello THERE!!", "abc"]
    rows = np.zeros((3, language.SPACE), np.uint8)
    for row, text in zip(rows, texts, strict=True):
        language.mark(text, row)
    assert (rows[0] == rows[1][: language.SPACE]).mean() > 0.999  # only the trailing blank differs
    model = language.solve(rows, ["a", "a", "b"])
    kernel = model.kernel(rows)
    sets = [set(np.flatnonzero(r)) for r in rows]
    chosen = [0, 2, 1]  # the languages take turns
    want = [[len(s & sets[c]) / np.sqrt(len(s) * len(sets[c])) for c in chosen] for s in sets]
    assert np.allclose(kernel, want, atol=1e-6)


def test_margins_equal_a_ridge_solved_from_scratch():
    """Presence kernels from sets, Nyström features and ridge as one least-squares problem."""
    texts = [_prose(i, (EN, FR, DE)[i % 3], 12 + i) for i in range(45)]
    label = ["en", "fr", "de"] * 15
    rows = np.zeros((45, language.SPACE), np.uint8)
    for row, text in zip(rows, texts, strict=True):
        language.mark(text, row)
    model = language.solve(rows, label, landmarks=12, ridge=0.05)
    sets = [set(np.flatnonzero(r)) for r in rows]
    kernel = lambda s, c: len(s & c) / np.sqrt(len(s) * len(c))
    marks = [sets[i] for i in (2, 0, 1, 5, 3, 4, 8, 6, 7, 11, 9, 10)]  # de, en, fr take turns
    value, vector = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    whiten = (vector / np.sqrt(value))[:, value > 1e-6 * value.max()]
    features = np.array([[kernel(s, c) for c in marks] for s in sets]) @ whiten
    weight = np.sqrt(1 / 15)
    tall = np.vstack([features * weight, np.sqrt(0.05 * 3 / 45) * np.eye(features.shape[1])])
    target = np.array([[1.0 if x == n else -1.0 for n in ("de", "en", "fr")] for x in label])
    beta = np.linalg.lstsq(tall, np.vstack([target * weight, np.zeros((features.shape[1], 3))]), rcond=None)[0]
    want = features @ beta
    found, scores = model.judge(texts)
    assert np.allclose(model.kernel(rows) @ model.coefficients, want, atol=1e-3)
    assert found == [("de", "en", "fr")[k] for k in want.argmax(1)] and np.allclose(scores, np.clip((1 + want.max(1)) / 2, 0, 1), atol=1e-3)


def test_numerals_are_no_letters():
    model = language.solve(np.eye(2, language.SPACE, dtype=np.uint8), ["a", "b"])
    assert model.judge(["²½①", "Ⅷ 12", "²½① é", "ʰ"])[0][:2] == ["und", "und"]
    assert "und" not in model.judge(["²½① é", "ʰ", "漢"])[0]


def test_every_language_is_learned(spark):
    rows = [(10 * k + i, " ".join([chr(97 + k // 26) + chr(97 + k % 26) + "q"] * 6), f"l{k:03d}") for k in range(150) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(docs, F.lit(True), sample=64).languages) == 150
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(True), language.fit(docs, F.lit(True), sample=64)).collect()} == {f"l{k:03d}" for k in range(150)}


def _prose(seed, words, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


EN, FR, DE = "the of and stone water which there think".split(), "le une être chaque où eau pierre très".split(), "der und nicht wasser stein über jeder".split()


def test_language_odd_rows(spark):
    rows = [(i, _prose(i, EN if i % 2 else FR, 60), "en" if i % 2 else "fr", "s", "x") for i in range(80)]
    odd = [(100, None, "en", "s", "x"), (101, "", "fr", "s", "x"), (102, " 123 !?", None, "s", "x"), (103, _prose(1, EN, 200_000), None, None, None), (None, _prose(2, FR, 9), None, "s", "x"), (104, "漢字かな混じりの文", None, "s", "x")]
    docs = spark.createDataFrame(rows + odd + [odd[4]], DOC)
    out = [tuple(r) for r in language.identify(docs, F.lit(True)).collect()]
    assert len(out) == len(rows) + len(odd) + 1
    by = {r[0]: r for r in out}
    assert [by[i][1:] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103][1] == "en" and by[None][1] == "fr"
    kept = language.keep_known(docs, F.col("lang").isNotNull())
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {*range(80), 103, None}
    empty = docs.limit(0)
    assert language.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


def _kept_beside(spark, train, texts):
    """Which of the texts the filter keeps beside its training rows."""
    docs = train.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(texts)], "doc_id long, text string, lang string"))
    return sorted(-1 - r["doc_id"] for r in language.keep_known(docs, F.col("lang").isNotNull()).where("doc_id < 0").select("doc_id").collect())


def test_filter_does_not_depend_on_length(spark):
    """Prose with a rare word in eight, short and long: its distinct n-grams grow, its language doesn't change."""
    train = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(r["text"] for r in train.where("lang = 'en'").orderBy("doc_id").limit(100).collect()).split()
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) if rng.random() < 0.12 else rng.choice(words)
    texts = [" ".join(word() for _ in range(n)) for n in (100, 1000, 10_000, 100_000)]
    assert len(texts[-1]) > 500_000
    assert _kept_beside(spark, train, texts) == [0, 1, 2, 3]


def test_filter_drops_an_unlearned_language_of_the_same_script(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = [r["text"] for r in docs.where("lang = 'en' AND length(text) > 200").orderBy("doc_id").collect()]
    assert len(_kept_beside(spark, docs.where("lang <> 'en'"), other)) <= 0.1 * len(other)
    latin = "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. Hi omnes lingua, institutis, legibus inter se differunt. "
    assert _kept_beside(spark, docs, [latin, latin * 100]) == []


#: Two pieces of real prose in each language of the tables, and the first of them in languages that aren't there and have no near relative there.
REAL = {
    "en": "The committee met on Tuesday to discuss the new budget for schools and hospitals. Several members asked whether the money would be enough to repair old buildings before winter. Nobody could give a clear answer, so the meeting was moved to next week.",
    "fr": "Le comité s'est réuni mardi pour discuter du nouveau budget des écoles et des hôpitaux. Plusieurs membres ont demandé si l'argent suffirait à réparer les vieux bâtiments avant l'hiver. Personne n'a pu donner de réponse claire, et la séance a été reportée à la semaine prochaine.",
    "es": "El comité se reunió el martes para discutir el nuevo presupuesto de las escuelas y los hospitales. Varios miembros preguntaron si el dinero alcanzaría para reparar los edificios viejos antes del invierno. Nadie pudo dar una respuesta clara, así que la reunión se aplazó hasta la próxima semana.",
    "de": "Der Ausschuss traf sich am Dienstag, um über den neuen Haushalt für Schulen und Krankenhäuser zu beraten. Mehrere Mitglieder fragten, ob das Geld reichen würde, um die alten Gebäude vor dem Winter zu reparieren. Niemand konnte eine klare Antwort geben, deshalb wurde die Sitzung auf nächste Woche verschoben.",
}
TALES = {
    "en": "There was once an old fisherman who lived alone by the sea with his cat. Every morning he went out in his small boat and came back in the evening with a few fish that he sold at the market in the next village.",
    "fr": "Il était une fois un vieux pêcheur qui vivait seul au bord de la mer avec son chat. Chaque matin il partait dans sa petite barque et revenait le soir avec quelques poissons qu'il vendait au marché du village voisin.",
    "es": "Había una vez un viejo pescador que vivía solo a la orilla del mar con su gato. Cada mañana salía en su pequeña barca y volvía por la tarde con algunos peces que vendía en el mercado del pueblo vecino.",
    "de": "Es war einmal ein alter Fischer, der allein mit seiner Katze am Meer lebte. Jeden Morgen fuhr er mit seinem kleinen Boot hinaus und kam am Abend mit einigen Fischen zurück, die er auf dem Markt des Nachbardorfes verkaufte.",
}
OTHER = [
    "Komisja zebrała się we wtorek, aby omówić nowy budżet szkół i szpitali. Kilku członków zapytało, czy pieniędzy wystarczy na naprawę starych budynków przed zimą.",
    "A bizottság kedden ült össze, hogy megvitassa az iskolák és kórházak új költségvetését. Több tag megkérdezte, elég lesz-e a pénz a régi épületek javítására a tél előtt.",
    "Komite salı günü okullar ve hastaneler için yeni bütçeyi görüşmek üzere toplandı. Birkaç üye paranın kıştan önce eski binaları onarmaya yetip yetmeyeceğini sordu.",
    "Ủy ban đã họp vào thứ Ba để thảo luận về ngân sách mới cho trường học và bệnh viện. Nhiều thành viên hỏi liệu tiền có đủ để sửa chữa các tòa nhà cũ trước mùa đông hay không.",
    "Комитет собрался во вторник, чтобы обсудить новый бюджет школ и больниц.",
]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_filter_keeps_real_prose_of_learned_languages(spark, sf):
    train = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model, lines = language.fit_filter(train, ~language.is_held_out())
    for texts in (REAL, TALES):
        assert model.judge(list(texts.values()))[0] == list(texts)
        assert lines.passed(list(texts.values()), model).all()
        assert lines.passed([" ".join([t] * 30) for t in texts.values()], model).all()
    assert not lines.passed(OTHER, model).any()
    assert not lines.passed([t * 30 for t in OTHER], model).any()


def test_short_texts_have_lines_of_their_own(spark):
    """No switch by length: at every length nearly all windows of learned texts pass, and no other script does."""
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500").collect()]
    model, lines = language.fit_filter(spark.read.parquet(f"{SF}/documents.parquet"), ~language.is_held_out())
    for n in (6, 12, 19, 20, 21, 50, 200):
        part = [t[i : i + n] for t in docs for i in (0, 500, 900)]
        assert lines.passed([p for p in part if language.has_letter(p)], model).mean() >= 0.95
        assert not lines.passed(["Комитет собрался во вторник, чтобы обсудить новый бюджет школ "[:n]], model).any()


def test_filter_keeps_the_learned_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.keep_known(docs, ~language.is_held_out()).count() == docs.count()


def test_quality_held_out(spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in quality.query(spark, SF).collect()}
    held = [i for i in marks if out[i]["held_out"]]
    good = [out[i]["score"] for i in held if marks[i] == 1]
    bad = [out[i]["score"] for i in held if marks[i] == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in out.values())


def _bags(seed, n):
    return [quality.bag_of(_prose(seed + i, EN if i % 2 else FR, 20 + 60 * (i % 5))) for i in range(n)]


def test_forward_pass_equals_brute_force():
    """Embedding means, layer, gated attention and scorer, passage by passage in plain Python."""
    model, bags = quality.train(_bags(0, 20), np.arange(20) % 2.0), _bags(50, 9) + [quality.bag_of("")]
    *_, logit = model.forward(*model.encoded(bags))
    for bag, got in zip(bags, logit, strict=True):
        hidden, attention, at = [], [], 0
        for shape, n in zip(bag.shape, bag.count, strict=True):
            mean = sum((model.table[g].astype(float) for g in bag.grams[at : at + n]), np.zeros(quality.EMBED)) / max(n, 1)
            at += n
            h = np.maximum(np.concatenate([(shape - model.mean) / model.scale, mean]) @ model.encode + model.encode_bias, 0)
            hidden.append(h)
            attention.append(float(np.tanh(h @ model.value) / (1 + np.exp(-(h @ model.gate))) @ model.attend))
        share = np.exp(attention) / np.exp(attention).sum()
        assert np.isclose(sum(a * h for a, h in zip(share, hidden, strict=True)) @ model.out + model.out_bias[0], got, atol=1e-4)


def test_gradients_equal_differences():
    model, bags = quality.train(_bags(0, 8), np.arange(8) % 2.0, epochs=1), _bags(90, 4)
    model = model._replace(table=model.table.astype(float))
    labels, weight = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 1])

    def loss():
        *_, logit = model.forward(*model.encoded(bags))
        return float((weight * (np.logaddexp(0, logit) - labels * logit)).mean())

    rng = np.random.default_rng(3)
    for p, d in zip(model[2:], quality.gradients(model, bags, labels, weight), strict=True):
        for at in rng.choice(np.flatnonzero(d.ravel()), 6):
            flat, step = p.reshape(-1), 1e-6
            flat[at] += step
            up = loss()
            flat[at] -= 2 * step
            down = loss()
            flat[at] += step
            assert np.isclose((up - down) / (2 * step), d.ravel()[at], rtol=1e-3, atol=1e-8)


def test_words_alone_can_be_learned():
    """Two vocabularies of equal letters and word lengths: only embeddings tell them apart."""
    words = [["".join(p) for p in (("ab", "cd", "ef"), ("ba", "dc", "fe"))[k]] for k in (0, 1)]
    bags = lambda seed: [quality.bag_of(_prose(seed + i, words[i % 2], 150)) for i in range(40)]
    model = quality.train(bags(0), np.arange(40) % 2.0)
    *_, logit = model.forward(*model.encoded(bags(1000)))
    assert ((logit > 0) == (np.arange(40) % 2 == 1)).mean() >= 0.95


def test_passages_describe_whole_texts():
    assert quality.bag_of(None).shape.shape == quality.bag_of("").shape.shape == (1, quality.WIDTH)
    long = "word " * 640_000
    assert len(quality.bag_of(long).count) == 10_000 and quality.bag_of(long).count.sum() == 2 * 640_000 - 1
    assert np.isclose(quality.bag_of("one two three four").shape[0, : quality._CLASSES].sum(), 1.0)
    assert quality.bag_of("same same same same").shape[0].tolist() != quality.bag_of("one two three four").shape[0].tolist()


def test_fit_bounds_rows_and_characters_not_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good stone " * (2000 + i), "en", "s", "x") for i in range(30)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, labels: seen.append(bags))
    quality.fit(docs, labels)
    quality.fit(docs, labels, chars=100_000)
    quality.fit(docs, labels, chars=10)
    quality.fit(docs, labels, sample=7)
    assert [len(bags) for bags in seen] == [30, 4, 1, 7]
    assert sorted(b.count.sum() for b in seen[0]) == [2 * 2 * (2000 + i) - 1 for i in range(30)]  # all words and pairs


def test_quality_odd_rows(spark):
    rows = [(i, _prose(i, EN, 80) + (" $$$ %%%" * 40 if i % 2 else ""), "en", "s", "x") for i in range(60)]
    odd = [(200, None, None, None, None), (201, "", "en", "s", "x"), (None, "the stone", "en", "s", "x"), (5, rows[5][1], "en", "s", "x")]
    docs = spark.createDataFrame(rows + odd, DOC)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(0, 0), (1, None), (None, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r["score"] for r in out}
    assert np.mean([by[i] for i in range(0, 60, 2)]) > 0.8 and np.mean([by[i] for i in range(1, 60, 2)]) < 0.2
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} >= set(range(0, 60, 2))
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}

"""Training-data operators against brute force, round trips and odd inputs."""

import random
import re
import unicodedata
from collections import Counter
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import boilerplate, consensus, distinctive, leaks, lookalikes, mojibake, packing, pieces, repetition, scans

DOC = "doc_id bigint, text string, source string, share double, key string"
CHUNK = "chunk_id string, text string, article_title string, source string, article string, khoan string, chunk_index int, field string, value string"
VI = "Sinh viên nộp đơn xin học bổng trước ngày mười lăm hằng tháng tại phòng đào tạo của trường"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, "x") for i, t, s in rows], DOC)


def chunk_df(spark, rows):
    return spark.createDataFrame([(i, t, a, s, "1", "2", 0, "f", "v") for i, t, a, s in rows], CHUNK)


# ---- 1


def judged(spark, rows):
    return spark.createDataFrame(rows, "topic_id int, chunk_id string, pass_no int, grade int, undo boolean, ts double")


def test_consensus_beats_the_majority_and_turns_a_liar(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    flip = {0: 2, 1: 1, 2: 0}
    for t in range(60):
        for c in range(5):
            g = truth[t, f"c{t}-{c}"] = rng.randrange(3)
            for p in rng.sample(range(1, 8), 4):
                right = g if p <= 2 else flip[g] if p == 3 else rng.choice([g, rng.randrange(3), rng.randrange(3)])
                rows.append((t, f"c{t}-{c}", p, right, None, float(p)))
    found, reliability = consensus.derive_consensus(judged(spark, rows))
    got = {(r.topic_id, r.chunk_id): r.grade for r in found.collect()}
    votes = {}
    for t, c, p, g, *_ in rows:
        votes.setdefault((t, c), Counter())[g] += 1
    ours = sum(got[k] == g for k, g in truth.items())
    majority = sum(votes[k].most_common(1)[0][0] == g for k, g in truth.items())
    assert ours > majority and ours >= 0.88 * len(truth)
    acc = {r.pass_no: r for r in reliability.collect()}
    assert acc[1].accuracy > 0.9 and acc[3].accuracy < 0.5 and acc[3].information > acc[6].information


def test_features_are_the_same_beyond_the_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(t, f"c{c}") for t in range(3) for c in range(t, 6)], "topic_id int, chunk_id string")
    topics = spark.createDataFrame([(0, "học phí kỳ hè"), (1, "lịch thi"), (2, None)], "topic_id int, question string")
    records = spark.createDataFrame([(f"c{c}", f"thông báo học phí {'lịch ' * c}") for c in range(9)] + [("c1", "thông báo học phí lịch ")], "chunk_id string, text string")
    rows = lambda: sorted((r.topic_id, r.chunk_id, *r.features) for r in consensus.item_features(items, topics, records).collect())
    small = rows()
    monkeypatch.setattr(consensus, "BROADCAST_ROWS", 0)
    assert rows() == small and len(small) == 15 and any(r[2] > 0 for r in small)


def test_consensus_takes_the_last_row_and_survives_odd_tables(spark):
    rows = [(1, "c", 1, 2, None, 1.0), (1, "c", 1, 0, None, 2.0), (1, "c", 1, 0, None, 2.0), (1, "c", 2, None, True, 9.0), (1, "c", 2, 1, None, 3.0), (None, "c", 1, 1, None, 1.0), (1, None, 1, 1, None, 1.0), (1, "d", 3, 2, None, None), (1, "d", None, 2, None, 1.0)]
    got = sorted(tuple(r) for r in consensus.standing_grades(judged(spark, rows)).collect())
    assert got == [(1, "c", 1, 0), (1, "d", 3, 2)]
    topics = spark.createDataFrame([(1, "q"), (None, None)], "topic_id int, question string")
    records = spark.createDataFrame([("c", None)], "chunk_id string, text string")
    found, _ = consensus.derive_consensus(judged(spark, rows), topics, records)
    assert {r.chunk_id: (r.grade, r.n_passes, r.agreement) for r in found.collect()}["c"][1:] == (1, 1.0)
    found, reliability = consensus.derive_consensus(judged(spark, []), topics, records)
    assert found.count() == reliability.count() == 0


# ---- 2


@pytest.mark.parametrize(
    "dirty, clean",
    [
        (unicodedata.normalize("NFD", VI), VI),
        ("ｈọｃ phí １２", "học phí 12"),
        ("học phí kỳ", "học phí kỳ"),
        ("h​ọc﻿ phí", "học phí"),
        ("hоc phі", "hoc phi"),
        ("ðược phép, Ðiều 1", "được phép, Điều 1"),
        ("Ηọc", "Họ" + "c"),
    ],
)
def test_lookalikes_come_out_in_one_form(spark, dirty, clean):
    for forms in (lookalikes.FIXED, lookalikes.lookalikes(spark)):
        assert forms.is_suspect(dirty) and forms.canonical(dirty) == (clean, True)
        assert forms.skeleton(dirty) == forms.skeleton(clean)


@pytest.mark.parametrize("dirty, clean", [("ρaypal", "paypal"), ("аррӏе", "apple"), ("αpple", "apple"), ("𝐇ello", "Hello"), ("ﬁnal", "final"), ("Ꭺpple", "Apple"), ("a\u2028b\u202ec\u2069", "a bc"), ("hоc phÃ­", "hoc phÃ­")])
def test_the_public_table_of_confusables_is_used(spark, dirty, clean):
    forms = lookalikes.lookalikes(spark)
    assert len(forms.prototypes) > 3000 and forms.is_suspect(dirty) and forms.canonical(dirty) == (clean, True)
    assert dirty == "hоc phÃ­" or forms.skeleton(dirty) == forms.skeleton(clean)


@pytest.mark.parametrize("answer", [None, lambda asked: "", lambda asked: asked.rsplit("\n", 1)[0], lambda asked: asked, lambda asked: unicodedata.normalize("NFD", asked), lambda asked: asked.replace("a", "")], ids=["missing", "empty", "short", "unchanged", "decomposed", "shifted"])
def test_without_the_public_table_there_is_no_result(spark, monkeypatch, answer):
    df = chunk_df(spark, [("a", "ρaypal", "𝐇ello", "s")])
    runs = [lambda: lookalikes.normalize_lookalikes(df), lambda: lookalikes.with_canonical(df, "text", "t"), lambda: lookalikes.skeleton_groups(df, "text")]
    real, checker = spark.sparkContext._jvm, SimpleNamespace(getSkeleton=answer)
    com = SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))))))

    class Jvm:
        def __getattr__(self, name):
            return com if name == "com" else getattr(real, name)

    with monkeypatch.context() as broken:
        broken.delattr(spark, "_docloom_confusables", raising=False)
        broken.setattr(spark.sparkContext, "_jvm", Jvm())
        for run in runs:
            with pytest.raises(RuntimeError, match="ICU"):
                run()
        # a failure isn't remembered
        broken.setattr(spark.sparkContext, "_jvm", real)
        assert sorted((r.field, r.canonical) for r in runs[0]().collect()) == [("article_title", "Hello"), ("text", "paypal")]


@pytest.mark.parametrize("proper", ["x̄", "Q̃ = 3", "σ̂", "ρgh", "𝑥 = 5", "αβγδ", "Ⅳ", "ταυ νοι λόγος", "Æsop", "❤️", "VÃ\u00a0 giÃ¡"])
def test_nothing_is_changed_without_need(spark, proper):
    assert lookalikes.lookalikes(spark).canonical(proper) == (proper, False)


@pytest.mark.parametrize("proper", [VI, "«Программа обмена» tiếng Nga", "日本語（N3） bậc", "α = 0,05 và σ²", "cliché, naïve, Zoë", "", "m² và °", "VÃ\xa0 giÃ¡"])
def test_proper_characters_stay(proper):
    assert lookalikes.canonical(proper) == (proper, False)


def test_lookalike_rows_and_groups(spark):
    df = chunk_df(spark, [("a", "hоc", "Điều", "s"), ("a", "hоc", "Điều", "s"), ("b", None, None, None), ("c", "", "", ""), ("d", "x " * 20000 + "​", unicodedata.normalize("NFD", "Điều"), "s")])
    got = sorted((r.chunk_id, r.field) for r in lookalikes.normalize_lookalikes(df).collect())
    assert got == [("a", "text"), ("d", "article_title"), ("d", "text")]
    groups = lookalikes.skeleton_groups(df.select("article_title", "text").union(df.limit(1).selectExpr("'Đіều'", "text")), "article_title").collect()
    assert [(g.title, g.n_forms, g.n_rows) for g in groups] == [("Điều", 3, 4)]
    forms = lookalikes.with_canonical(df, "article_title", "t").groupBy("t").count().collect()
    assert {r.t: r["count"] for r in forms}["Điều"] == 3
    assert lookalikes.normalize_lookalikes(df.limit(0)).count() == 0


# ---- 3


def brute_lines(rows):
    key = lambda line: re.sub(r"[\W\d_]+", "", line.lower())
    out = set()
    for s in {s for _, _, s in rows if s is not None}:
        own = {(i, t) for i, t, x in rows if x == s and t is not None}
        count = Counter(k for _, t in own for k in {key(x) for x in t.split("\n")} if k)
        out |= {(i, n) for i, t in own for n, x in enumerate(t.split("\n"), 1) if key(x) and count[key(x)] >= 3 and count[key(x)] * 5 >= len(own)}
    return out


@pytest.mark.parametrize("counters", [1024, 2])
def test_repeated_lines_equal_brute_force(spark, counters):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.sample(["SHARE  this!", "share this 9", "Bản quyền", "---", ""], 3) + [f"dòng riêng {chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]), rng.choice(["a", "a", "b", None])) for i in range(120)]
    rows += [(500, None, "a"), (501, "", "b"), rows[0], (502, "x\n" * 5000, "c")]
    found = boilerplate.find_repeated_lines(docs(spark, rows), counters=counters)
    assert {(r.doc_id, r.line_no) for r in found.collect()} == brute_lines(rows)
    assert found.count() == len(brute_lines(rows))


def test_repeated_lines_are_removed_both_ways(spark, monkeypatch):
    rows = [(i, f"SHARE this\nriêng {'abcdefgh'[i]}", "a") for i in range(8)] + [(9, None, "a"), (10, "khác", None)]
    want = {i: f"riêng {'abcdefgh'[i]}" for i in range(8)} | {9: None, 10: "khác"}
    df = docs(spark, rows)
    assert {r.doc_id: r.text for r in boilerplate.remove_repeated_lines(df).collect()} == want
    monkeypatch.setattr(boilerplate, "BROADCAST_ROWS", 0)
    out = boilerplate.remove_repeated_lines(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == want
    assert boilerplate.find_repeated_lines(df.limit(0)).count() == 0


# ---- 4


@pytest.mark.parametrize("text", ["Một câu ngắn. " * 80, "x" * 2000, "từ " * 700, ("Đoạn văn. " * 9 + "\n\n") * 12, "a" * 513, "á" * 600, " " * 1200, "a" + "\u0301" * 700, "từ " + "e" + "\u0301" * 3000 + " hết.", "Câu dài " + "y" * 900 + " hết. " + "z " * 300])
def test_pieces_are_short_ordered_and_complete(text):
    cuts = pieces.split_text(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < b - a <= 512 for a, b in cuts)
    assert all(0 <= b - c <= 64 and c > a for (a, b), (c, _) in zip(cuts, cuts[1:]))
    assert text[: cuts[0][1]] + "".join(text[p:b] for (_, p), (_, b) in zip(cuts, cuts[1:])) == text
    assert "\u0301" * 99 in text or all(not unicodedata.combining(text[b]) for _, b in cuts[:-1])


def test_pieces_cut_at_sentences_where_they_can():
    text = "Sinh viên nộp đơn đúng hạn. " * 40
    assert all(text[:b].rstrip().endswith(".") for _, b in pieces.split_text(text))
    mixed = "Một hai ba bốn, năm. Sáu bảy tám chín mười một. " * 30
    assert all(mixed[a - 2] in ".," for a, _ in pieces.split_text(mixed)[1:])  # pieces begin at a boundary as good as there is
    assert pieces.split_text("") == [] and pieces.split_text("x" * 512) == [(0, 512)]
    long = "Câu một hai ba. " * 20000
    assert pieces.split_text(long)[-1][1] == len(long)


def test_piece_rows(spark):
    df = chunk_df(spark, [("a", "Câu. " * 300, "", "s"), ("b", None, "", "s"), ("c", "", "", "s"), ("d", "ngắn", "", "s")])
    got = pieces.split_oversized(df)
    one = {r.chunk_id: r for r in got.where("piece_no = 1").collect()}
    assert one["a"].n_pieces == got.where("chunk_id = 'a'").count() > 1
    assert (one["b"].text, one["b"].end, one["c"].n_pieces, one["d"].text, one["d"].article) == (None, 0, 1, "ngắn", "1")
    assert pieces.split_oversized(df.limit(0)).count() == 0


# ---- 5


def page_df(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "source string, page int, text string, kind string")


def scan_pages(spark):
    body = ["Phòng đào tạo nhận hồ sơ của sinh viên", "trong giờ hành chính và trả kết quả đúng hạn.", "Giảng viên xét đơn theo quy định hiện hành của trường."]
    rows = []
    for p in range(1, 9):
        own = " ".join(["riêng", "abcdefgh"[p - 1] * 5, "trang"])
        rows.append(("f", p, "\n".join(["QUY CHẾ HỌC VỤ CỦA TRƯỜNG", own, *body, own, str(p)])))
    rows[3] = ("f", 4, "\n".join(["QUY CHẾ HỌC V1 CỦA TRƯỜNG", "Phòng đào tạo nhận hồ sơ của si-", "nh viên trong gi{ờ hành chính.", "Mức 25-", "37 tín chỉ. Giản9 viên xét đơn the-", "— 4 —"]))
    rows[4] = ("f", 5, "\n".join(["QUY CHẾ HỌC VỤ CỦA TRƯỜNG", "o quy định hiện hành của trường.", "Giang vien xet don theo quy dinh hien hanh cua truong.", "Trang 5"]))
    return page_df(spark, [*rows, rows[0], ("g", None, "Một trang lẻ.\n7"), ("h", 1, None), (None, 1, "x"), ("e", 1, "")])


def test_scans_are_repaired(spark):
    got = {(r.source, r.page): r for r in scans.mend_scans(scan_pages(spark)).collect()}
    kinds = {k: {(f.line_no, f.kind) for f in r.found} for k, r in got.items()}
    assert kinds["f", 4] == {(1, "running"), (2, "broken_word"), (3, "misread"), (5, "broken_word"), (5, "misread"), (6, "page_no")}
    assert kinds["f", 5] == {(1, "running"), (3, "misread"), (4, "page_no")}
    assert kinds["f", 2] == {(1, "running"), (7, "page_no")}
    assert kinds["g", None] == kinds["e", 1] == set()
    assert "sinh viên trong giờ hành chính." in got["f", 4].text and "Giảng viên xét đơn theo" in got["f", 4].text and "25-" in got["f", 4].text
    assert "Giảng viên xét đơn theo quy định hiện hành của trường." in got["f", 5].text
    assert len(got) == 10
    assert scans.mend_scans(scan_pages(spark).limit(0)).count() == 0


def test_word_broken_over_a_page_is_said_once_and_paragraphs_go_on(spark):
    body = "The academic staff begins the semester with a review of all open files. " * 3
    rows = [("f", p, f"{body}\n") for p in range(1, 7)]
    rows += [("g", 1, "The academic staff begins the seme-"), ("g", 2, "ster with a review of"), ("g", 3, "all open files.\n\nThe staff begins."), ("g", 5, "The review of files.")]
    mended = scans.mend_scans(page_df(spark, rows))
    got = {(r.source, r.page): r for r in mended.collect()}
    assert got["g", 1].text == "The academic staff begins the semester" and got["g", 2].text == "with a review of"
    assert [got["g", p].continues for p in (1, 2, 3, 5)] == [False, True, True, False]
    text = {(r.page, r.paragraph_no): r.text for r in scans.paragraphs(mended).where("source = 'g'").collect()}
    assert text == {(1, 1): "The academic staff begins the semester with a review of all open files.", (3, 2): "The staff begins.", (5, 1): "The review of files."}
    assert scans.paragraphs(mended.limit(0)).count() == 0


def test_furniture_of_any_height_is_found(spark):
    own = [" ".join(random.Random(p).sample(VI.split(), 9)) for p in range(9)]
    rows = [("f", p, "\n".join(["ĐẠI HỌC QUỐC GIA", "TRƯỜNG KHOA HỌC", "PHÒNG ĐÀO TẠO", "Quy chế học vụ", "Bản lưu hành nội bộ", f"mở đầu {'abcdefghi'[p]}", own[p], f"kết {'abcdefghi'[p]} hết", str(p)])) for p in range(1, 9)]
    got = {r.page: {(f.line_no, f.kind) for f in r.found} for r in scans.mend_scans(page_df(spark, rows)).collect()}
    assert all(got[p] == {*((n, "running") for n in range(1, 6)), (9, "page_no")} for p in range(1, 9))


def test_words_of_letters_are_weighed_by_their_neighbours():
    words = {w: 50 for w in ("open", "files", "every", "review", "staff")}
    v = scans.Vocabulary(words, {("review", "every"): 9, ("every", "files"): 9})
    found = lambda text: scans.repair_page(v, text, 1, [], [], None)
    assert found("staff review evory files") == ([(1, "misread")], "staff review every files")
    assert found("staff review Evory files")[0] == found("staff open evory files")[0] == []


def test_misread_halves_of_broken_words_are_found():
    v = scans.Vocabulary({w: 50 for w in ("academic", "applicant", "the", "staff", "turn", "over", "modern")}, {})
    rows = lambda text, **k: scans.repair_page(v, text, 1, [], [], k.get("next_word"), k.get("last_word"))[0]
    assert rows("the staff ac-\nadernic staff") == [(1, "broken_word"), (2, "misread")]
    assert rows("the staff apphca-\nnt staff") == [(1, "broken_word"), (1, "misread")]
    assert rows("the staff aca-\ndemic staff") == rows("the staff mo-\ndern staff") == [(1, "broken_word")]
    assert rows("the staff apphca-", next_word="nt") == [(1, "broken_word"), (1, "misread")]
    assert rows("adernic staff", last_word="ac-") == [(1, "misread")]
    assert rows("demic staff", last_word="aca-") == rows("the staff", last_word="staff") == []


def test_trie_retrieval_is_complete():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(200)}
    trie = scans.Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    for w in ["abcab", "a", "ccc", "bbbbbbbb"]:
        for k in (1, 2):
            assert dict(trie.within([w, "zz"], k)[0]) == {v: distance(w, v) for v in words if distance(w, v) <= k}
    assert scans.Trie([]).within(["a"], 2) == [[]] and scans.Trie(["ab"]).within([], 1) == []


# ---- 6


def test_term_weights_equal_the_formula(spark):
    texts = {"a": "học phí học bổng", "b": "học phí", "c": "thư viện", "d": "học Phí PHÍ phí", "e": None}
    df = chunk_df(spark, [(k, t, "", "s") for k, t in [*texts.items(), ("a", texts["a"])]])
    n = 5
    for r in distinctive.term_weights(df).collect():
        own = [t.lower().split() for t in texts.values() if t]
        d, c = sum(r.term in t for t in own), sum(t.count(r.term) for t in own)
        assert (r.df, r.cf) == (d, c)
        assert r.idf == pytest.approx(np.log2(n / d)) and r.ridf == pytest.approx(np.log2(n / d) + np.log2(-np.expm1(-c / n)))
    scores = {(r.chunk_id, r.term): r.tf for r in distinctive.score_terms(df, distinctive.term_weights(df)).collect()}
    assert scores["d", "phí"] == 3 and scores["a", "học"] == 2


@pytest.mark.parametrize("seed_docs, block", [(64, 100000), (1, 3)])
def test_best_records_equal_brute_force(spark, seed_docs, block):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = {f"c{i:03d}": " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(40)], k=12)) for i in range(150)}
    asked = {t: " ".join(rng.sample(vocab, 6)).upper() for t in range(10)} | {10: "không đâu", 11: ""}
    df = chunk_df(spark, [(k, t, "", "s") for k, t in [*texts.items(), *list(texts.items())[:9]]])
    topics = spark.createDataFrame([*asked.items(), (None, "w1"), (12, None)], "topic_id int, question string")
    d = Counter(w for t in texts.values() for w in set(t.split()))
    want = {}
    for k, q in asked.items():
        scored = [(-round(sum(np.log2(150 / d[w]) for w in set(q.lower().split()) & set(t.split())), 9), c) for c, t in texts.items() if set(q.lower().split()) & set(t.split())]
        if scored:
            want[k] = min(scored)[1]
    got = {r.topic_id: r.chunk_id for r in distinctive.best_records(df, topics, seed_docs=seed_docs, block=block).collect()}
    assert got == want


# ---- 7


def garble(text, *steps):
    for codec in steps:
        raw = text.encode("utf-8")
        table = {b: c for c, b in mojibake._CODECS[codec].items() if ord(c) > 159 or b < 160}
        text = "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in raw)
    return text


def clean_rows():
    rng = random.Random(0)
    parts = VI.split()
    return [(f"k{i}", f"{i}. " + " ".join(rng.sample(parts, 12)) + ". The student should submit the form in time.", "", f"quy-chế-học-phí-{i}.pdf") for i in range(80)]


def test_garbled_text_is_found_and_restored(spark):
    tcvn = {c: chr(b) for b, c in mojibake.TCVN.items()}
    bad = {"u1": garble(VI, "cp1252"), "u2": garble(VI, "cp1252", "cp1252"), "m": garble(VI, "mac_roman"), "t": "".join(tcvn.get(c, c) for c in VI)}
    lost = {"q": "Ng??i h?c n?p ??n", "f": "Ng��i học"}
    fine = {"ok": "São Vale, naïve façade, «Программа», m², có phải không?", "n": None, "e": ""}
    rows = clean_rows() + [(k, v, "", "s.pdf") for k, v in {**bad, **lost, **fine}.items()] + [("u1", bad["u1"], "", "s.pdf"), ("src", "ổn", "", garble("quy-chế-học-phí.pdf", "cp1252"))]
    got = {(r.chunk_id, r.field): r for r in mojibake.repair_encoding(chunk_df(spark, rows)).collect()}
    assert set(got) == {(k, "text") for k in [*bad, *lost]} | {("src", "source")}
    assert all(got[k, "text"].restored == VI for k in bad)
    assert got["u2", "text"].chains == ["cp1252>utf-8|cp1252>utf-8"]
    assert all(got[k, "text"].lost for k in lost) and got["src", "source"].restored == "quy-chế-học-phí.pdf"
    assert mojibake.repair_encoding(chunk_df(spark, rows).limit(0)).count() == 0


def test_question_marks_alone_are_no_loss():
    for t in ("What is this?? Really", "Is it so ? Yes", "tel: 123-?", "xem http://a.b/c?id=3 nhé", "sao?", "Vì sao?\nvà thế nào", "", "(?)"):
        assert not mojibake.lost(t)
    for t in ("Ng??i h?c", "tuần 5 ? hết", "th?-vi?n.pdf", "?n", "a\ufffd"):
        assert mojibake.lost(t)


# ---- 8


def test_packing_keeps_every_token_once(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(VI.split(), k=rng.randrange(1, 900))) for _ in range(150)] + ["từ " * 3000, "", None, "a  b\n\n c ", "x" * 5000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")])
    got = packing.pack_documents(df, part_items=40).collect()
    encode = packing.encoder().encode_ordinary
    by_doc, by_box = {}, Counter()
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        by_box[r.container] += r.n_tokens
    for i, t in enumerate(texts):
        n, at = len(encode(t or "")), 0
        for first, k in sorted(by_doc.get(i, [])):
            assert first == at
            at += k
        assert at == n and (len(by_doc.get(i, [])) <= 1 or n > packing.CAPACITY)
    assert max(by_box.values()) <= packing.CAPACITY
    parts = {(r.part, r.container if r.part == "full" else ""): (r.part_containers, r.part_bound) for r in got}
    assert all(n >= bound for n, bound in parts.values()) and sum(bound for _, bound in parts.values()) <= len(by_box)
    assert all(r.whole for r in packing.whole_documents(packing.pack_documents(df)).collect())
    assert packing.packing_report(packing.pack_documents(df)).first().used > 0.93
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        where, n = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(where, weights=sizes).max() <= 100
        assert -(-sizes.sum() // 100) <= packing.lower_bound(sizes, 100) <= n
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 6), 100) == 3
    counter = packing.TokenCounter()
    for t in ["một hai ba", " đầu", "cuối ", "a\nb c\n", "x y z", "it's 12 34", ""]:
        assert counter.count(t) == len(counter.encode(t))


# ---- 9

ITEM = "Theo thể lệ Ziramova đề cương mượn phòng thí nghiệm của nhóm Zedrugoki do ai đăng ký và quỹ Zagostuklo chi mấy phần cho khối Vuribrura"


def test_leaks_with_edits_are_found_and_removed(spark):
    w = ITEM.split()
    edited = [*w[:7], "thêm", *w[7:15], *w[16:]]
    noise = "nội dung khác hẳn không liên quan gì đến câu hỏi nào trong bộ đề kiểm tra".split()
    rows = [
        (1, " ".join([*noise, *w[3:17], *noise]), "s"), (2, " ".join([*noise, *w[3:15], *noise]), "s"), (3, " ".join([*noise, *edited, *noise]), "s"),
        (4, " ".join(noise), "s"), (5, None, "s"), (6, "", "s"), (7, unicodedata.normalize("NFD", ITEM.upper()).replace(" ", ",\n "), "s"), (8, ("x " * 30000) + ITEM, "s"), (1, " ".join([*noise, *w[3:17], *noise]), "s"),
    ]
    items = spark.createDataFrame([(10, ITEM, "Một câu trả lời ngắn"), (11, None, None), (12, "", "")], "id int, question string, answer string")
    df = docs(spark, rows)
    assert {(r.doc_id, r.item_id, r.field) for r in leaks.find_leaks(df, items).collect()} == {(i, 10, "question") for i in (1, 3, 7, 8)}
    left = {r.doc_id: r for r in leaks.remove_leaks(df, items, max_coverage=0.9).collect()}
    assert left[1].n_removed == 14 and left[1].text.split() == [*noise, *noise] and left[4].text == " ".join(noise) and left[5].text is None and 7 not in left
    assert leaks.find_leaks(df.limit(0), items).count() == leaks.find_leaks(df, items.limit(0)).count() == 0


def replaced(words, places):
    return [f"khác{i}" if i in places else w for i, w in enumerate(words)]


def test_leak_is_kept_where_its_continuation_is_more_edited():
    w = [f"từ{a}{b}" for a in "abcdefgh" for b in "klmno"]
    noise = [f"lời{i}" for i in range(30)]
    finder = leaks.LeakFinder([(1, "question", " ".join(w))])
    found = lambda words: [h[2:] for h in finder.find_all([" ".join([*noise, *words, *noise])])[0]]
    assert found(replaced(w[:23], {14, 17, 20})) == [(20, 18, 30, 50)]
    assert found(replaced(w[:23], {2, 5, 8})) == [(20, 18, 33, 53)]
    assert found(replaced(w, {3, 6, 9, 26, 29, 32})) == found(replaced(w, {3, 6, 9, 22, 25, 28})) == [(30, 27, 40, 70)]
    assert found(replaced(w, set(range(3, 40, 4)))) == found(replaced(w[:16], {3, 12})) == found(w[:13]) == []


@pytest.mark.parametrize("length, edits", [(15, {10}), (15, {4}), (20, {4, 15}), (19, {4, 14})])
def test_leak_with_a_single_run_of_nine_or_ten_words_is_found(length, edits):
    w = [f"từ{a}{b}" for a in "abcd" for b in "klmno"][:length]
    noise = [f"lời{i}" for i in range(30)]
    finder = leaks.LeakFinder([(1, "question", " ".join(w))])
    assert finder.find_all([" ".join([*noise, *replaced(w, edits), *noise])]) == [[(1, "question", length, length - len(edits), 30, 30 + length)]]


def test_leaks_equal_brute_force_over_patterns_of_edits():
    rng = random.Random(11)
    w = [f"từ{a}{b}" for a in "abcdefghi" for b in "klmnopqr"]
    finder = leaks.LeakFinder([(1, "question", " ".join(w))])
    noise = [f"lời{i}" for i in range(30)]
    for trial in range(4000):
        edits = rng.choice([0, 1, 1, 2, 2, 2, 3, 3, 4])
        runs = [2] * (edits + 1)
        for _ in range(rng.randint(14, 36) - sum(runs)):
            runs[rng.randrange(edits + 1) if rng.random() < 0.8 else 0] += 1
        doc, at = [], rng.randrange(9)
        for k, n in enumerate(runs):
            doc += w[at : at + n]
            kind = rng.choice(["add", "drop", "replace"]) if k < edits else ""
            at += n + (kind in ("drop", "replace"))
            doc += [f"x{trial}{k}"] * (kind in ("add", "replace"))
        want = any((n := sum(runs[p : q + 1])) >= 14 and q - p <= 0.12 * (n + q - p) for p in range(edits + 1) for q in range(p, edits + 1))
        assert bool(finder.find_all([" ".join([*noise, *doc, *noise])])[0]) == want, (runs, doc)


def test_added_words_are_edits():
    w = [f"từ{a}{b}" for a in "abcd" for b in "klmnopqr"]
    finder = leaks.LeakFinder([(1, "question", " ".join(w))])
    found = lambda *parts: [h[2:4] for h in finder.find_all([" ".join(chain.from_iterable(parts))])[0]]
    five = [p for k in range(5) for p in (w[4 * k : 4 * k + 4], [f"x{k}"])]
    assert found(*five, w[20:22]) == []  # 22 equal words, 5 added
    assert found(w[:5], ["x"], w[5:10], ["y"], w[10:14]) == []  # 14 equal words, 2 added
    assert found(w[:5], ["x"], w[5:10], ["y"], w[10:15]) == [(15, 15)]
    assert found(w[:12], ["x", "y"], w[12:24]) == [(24, 24)]


def test_templates_with_many_items_hide_no_leak():
    head = [f"mẫu{i}" for i in range(9)]
    own = lambda k: [f"riêng{k}{c}" for c in "abcdefghijkl"]
    items = [(k, "question", " ".join([*head, *own(k)])) for k in range(200)]
    finder = leaks.LeakFinder(items)
    doc = [*head[:7], "khác", head[8], *own(3)]
    assert [h[0] for h in finder.find_all([" ".join(doc)])[0]] == [3]
    assert finder.find_all([" ".join([*head, "hết", *head])]) == [[]]
    # another item's text is no leak for what both have of one template
    twins = leaks.LeakFinder([(k, "question", " ".join([*head, f"tên{k}", *own(9)])) for k in (1, 2)])
    assert [h[0] for h in twins.find_all([" ".join([*head, "tên1", *own(9)])])[0]] == [1]
    assert sorted(h[0] for h in twins.find_all([" ".join([*head, "tên3", *own(9)])])[0]) == [1, 2]
    # the edited word is the other item's own: its run ends only in one item
    pair = leaks.LeakFinder([(1, "question", " ".join([*head, "y", *own(1)[:6]])), (2, "question", " ".join([*head, "x", *own(2)]))])
    assert [h[0] for h in pair.find_all([" ".join([*head, "x", *own(1)[:6]])])[0]] == [1]


def test_blocks_of_items_and_repeated_passages(spark):
    own = lambda k: " ".join(f"riêng{k}{c}" for c in "abcdefghijklmnop")
    items = spark.createDataFrame([(k, own(k), None) for k in range(12)], "id int, question string, answer string")
    df = docs(spark, [(k, f"đầu {own(k)} giữa {own(k)} cuối " + "x " * 40, "s") for k in range(12)])
    whole = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, items).collect()}
    assert whole == {(k, k) for k in range(12)} == {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, items, max_item_words=40).collect()}
    for n in (100_000, 40):
        left = leaks.remove_leaks(df, items, max_item_words=n).collect()
        assert {(r.doc_id, r.n_removed) for r in left} == {(k, 32) for k in range(12)} and all(r.text.split()[:3] == ["đầu", "giữa", "cuối"] for r in left)


def test_automaton_equals_brute_force():
    rng = random.Random(6)
    texts = [[rng.randrange(1, 5) for _ in range(30)] for _ in range(4)]
    sam = leaks.SuffixAutomaton(texts)
    stream = [rng.randrange(0, 6) for _ in range(200)]
    known = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    lengths, runs = sam.stream(stream)
    for i in range(200):
        n = 0
        while n <= i and tuple(stream[i - n : i + 1]) in known:
            n += 1
        assert lengths[i] == n
    met = set()
    for end, n, state in runs:
        while state > 0 and n >= leaks.SEED_WORDS:
            met |= {(end, k, at) for k, at in sam.occ[state]}
            state = sam.link[state]
            n = sam.length[state]
    for k, t in enumerate(texts):
        for at in range(4, 30):
            for end in range(5, 201):
                if stream[end - 5 : end] == t[at - 4 : at + 1] and not (end < 200 and at < 29 and stream[end] == t[at + 1]):
                    assert (end, k, at) in met


# ---- 10


def test_repeated_share_by_hand():
    w = [f"w{i}" for i in range(20)]
    assert repetition.repeated_share(w) == 0
    assert repetition.repeated_share(w + w) == 0.5
    assert repetition.repeated_share(["a", "b"] * 20) == 38 / 40
    assert repetition.repeated_share(w[:7] + ["x"] + w[:7]) == 0
    assert repetition.normal_words("Lần 1: A1 \n B 22") == ["lần", ":", "a", "b"]


def test_repetitive_documents_equal_the_exact_measure(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdghklmn" for b in ("an", "ong", "inh", "uy", "oa")]
    rows = []
    for i in range(160):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            base = base[:20] * rng.randrange(3, 9)
        rows.append((i, " ".join(base), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "la " * 50000, "s"), rows[0]]
    df = docs(spark, rows)
    want = {i for i, t, _ in rows if repetition.repeated_share(repetition.normal_words(t or "")) >= repetition.LIMIT}
    assert {r.doc_id for r in repetition.measure_repetition(df).where("repetitive").collect()} == want
    exact = {(i, round(repetition.repeated_share(repetition.normal_words(t or "")), 9)) for i, t, _ in rows}
    assert {(r.doc_id, round(r.share, 9)) for r in repetition.measure_repetition(df).collect()} == exact
    assert {r.doc_id for r in repetition.measure_repetition(df.limit(5)).where("repetitive").collect()} == {0}
    assert repetition.measure_repetition(df.limit(0)).count() == 0


def test_long_texts_said_twice_are_measured(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        base = [f"w{rng.randrange(900)}" + rng.choice("abcdefgh") for _ in range(rng.randrange(60, 300))]
        rows.append((i, " ".join(base[:20] * rng.randrange(4, 9) if i % 4 == 0 else base), "s"))
    for i, n in enumerate((1000, 2000, 4000, 8000)):
        once = ["".join(rng.choice("abcdefghiklmnopqrstuvxy") for _ in range(5)) for _ in range(n)]
        rows += [(900 + i, " ".join(once + once), "s"), (950 + i, " ".join(once), "s")]
    got = {r.doc_id: r for r in repetition.measure_repetition(docs(spark, rows), train_rows=150).collect()}
    assert all(got[i].repetitive and got[i].share == 0.5 for i in range(900, 904))
    assert all(not got[i].repetitive and got[i].share == 0 for i in range(950, 954))

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import crf, encodings, leaks, packing, pairs, pii


# --- encodings


def test_garbled_texts_are_found_and_restored(spark):
    r = random.Random(1)
    words = "quy định về nghỉ bù cuối quý áp dụng cho đội kho lạnh với hạn ngày làm việc để tránh xử lý trùng hồ sơ".split()
    clean = [" ".join(r.choices(words, k=25)) + "." for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(clean)]
    broken = {}
    for i, (page, times) in enumerate([("cp1252", 1), ("latin-1", 1), ("mac_roman", 1), ("cp437", 1), ("latin-1", 2), ("latin-1", 4), ("cp1252", 5)]):
        text = clean[i]
        for _ in range(times):
            text = "".join(bytes([b]).decode(page, "replace") if page != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
        broken[1000 + i] = (text, clean[i])
    broken[1010] = (clean[9].encode("ascii", "replace").decode(), None)
    broken[1011] = (clean[10].encode("latin-1", "replace").decode("utf-8", "replace"), None)
    extra = [(2000, None), (2001, ""), (2002, "São Vero, Café Môn, 80 €. Vì sao? Có"), (2003, clean[3].upper())]
    frame = spark.createDataFrame(rows + [(k, v[0]) for k, v in broken.items()] + extra, "row_id bigint, chunk_text string")
    got = {x.row_id: x.restored for x in encodings.restored(frame).collect()}
    assert set(got) == set(broken)
    assert all(got[k] == want for k, (_, want) in broken.items() if want)
    assert encodings.restored(frame.where("1=0")).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_frequent_damage_is_found_too(spark, alike):
    r = random.Random(6)
    words = "quy định về nghỉ bù cuối quý áp dụng cho đội kho lạnh với hạn ngày làm việc để tránh xử lý trùng hồ sơ đó đúng".split()
    clean = [" ".join(r.choices(words, k=25)) + "." for _ in range(600)]
    garbled = lambda t: "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode())
    origin = {1000 + i: clean[0 if alike else i] for i in range(300)}  # a third of all rows
    frame = spark.createDataFrame([*enumerate(clean), *((k, garbled(t)) for k, t in origin.items())], "row_id bigint, chunk_text string")
    assert {x.row_id: x.restored for x in encodings.restored(frame).collect()} == origin


# --- conditional random field


def test_viterbi_like_brute_force():
    r = np.random.default_rng(2)
    chain = crf.Chain(("a", "b", "c"), np.zeros((1, 3), np.float32), r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32))
    lengths = [1, 4, 0, 5, 2]
    offsets = np.append(0, np.cumsum(lengths))
    emissions = r.normal(size=(offsets[-1], 3)).astype(np.float32)
    got = chain.decode(emissions, offsets)
    import itertools

    for s, e in zip(offsets, offsets[1:]):
        if e > s:
            score = lambda p: chain.begin[p[0]] + sum(emissions[s + i, k] for i, k in enumerate(p)) + sum(chain.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert tuple(got[s:e]) == max(itertools.product(range(3), repeat=e - s), key=score)


# --- personal data


def test_personal_data_on_held_out_lines():
    lines = pii.LABELLED.read_text(encoding="utf-8").splitlines()
    chain = pii.fitted(lines[: len(lines) * 3 // 4], epochs=8)
    texts, items = pii.labelled(lines[len(lines) * 3 // 4 :])
    found = {row: {(text[s:e], k) for s, e, k in spans} for row, text, spans in pii.spans(chain, pa.array(texts))}
    want = {(i, t[s:e], k) for i, t in enumerate(texts) for s, e, k in items[i]}
    got = {(i, t, k) for i, pieces in found.items() for t, k in pieces}
    assert len(want & got) / len(want) > 0.93 and len(want & got) / len(got) > 0.93


def test_masking_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Họ tên: Giáp Diệp Thạch\nĐT: 0549.593.141\nThư: thach@lienlac.test"), (2, None), (3, ""), (4, "Đơn hàng 343815469231 thuộc lô 360943, đóng 50 kiện.")], "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.replaced) for r in pii.masked(docs).collect()}
    assert got[1] == ("Họ tên: [PERSON_NAME]\nĐT: [PHONE]\nThư: [EMAIL]", 3)
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4][1] == 0
    assert {(r.doc_id, r.pii_type) for r in pii.found(docs).collect()} == {(1, "person_name"), (1, "phone"), (1, "email")}


def test_long_addresses_are_masked_to_their_ends(spark):
    long = "nguyen.van.a" + ".b" * 30 + "@" + "a-very-long-sub-domain-name-of-a-department." * 6 + "example.com"
    docs = spark.createDataFrame([(1, f"Thư: {long}\nĐT: 0549.593.141"), (2, "Thư: thach [at] phong-ban [dot] lienlac [dot] test, gửi trước thứ hai"), (3, "Thư: " + "x" * 50_000 + "@lienlac.test")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert got == {1: "Thư: [EMAIL]\nĐT: [PHONE]", 2: "Thư: [EMAIL], gửi trước thứ hai", 3: "Thư: [EMAIL]"}
    text = "a@b.co " + "x" * 200_000 + " c [at] d [dot] com"
    assert [text[s:e] for s, e in pii._addresses(text, 0, len(text))] == ["a@b.co", "c [at] d [dot] com"]


# --- pairs


def test_pairs(spark):
    q = "Ai duyệt yêu cầu nghỉ bù cuối quý của khối văn phòng?"
    good = "Khối văn phòng được áp dụng nghỉ bù cuối quý trong 89 phút"
    answers = {
        "ok": good + ".", "no_stop": good, "quantity": "74 tuần", "null": None, "blank": " ​", "placeholder": "(trống)", "refusal": "Xin lỗi, tôi không thể trả lời câu hỏi này.",
        "echo": q.upper(), "echo_answer": f"Bạn hỏi “{q}” – {good}.", "foreign": "Bitte reichen Sie das Formular innerhalb von 51 Minuten am Schalter ein und warten Sie auf die Antwort.",
        "cut": good + ". Nội dung thanh lý thiết bị cũ được", "list": "- Xin gia hạn quyền tạm\n- Lưu nhật ký thao tác", "long": (good + ". ") * 2000,
    }
    states = spark.createDataFrame([(k, q, a) for k, a in answers.items()] + [("nothing", None, "")], "run_id string, task string, final_answer string")
    questions = spark.createDataFrame([("q1", q, None)], "id string, question string, expected_answer string")
    got = {(r.source_table, r.pair_key): r.defect for r in pairs.flagged(states, questions).collect()}
    want = {"null": "empty", "blank": "empty", "placeholder": "empty", "refusal": "refusal", "echo": "copies_question", "foreign": "wrong_language", "cut": "truncated", "nothing": "empty"}
    assert got == {("agent_state", k): v for k, v in want.items()} | {("test_questions", "q1"): "empty"}


def test_clause_tags_on_held_out_pairs():
    """Trained on three quarters of the labelled pairs, none of whose questions stand in the rest."""
    rows = pairs.labelled_pairs()
    held = {q for i, q in enumerate(sorted({r["question"] for r in rows})) if i % 4 == 0}
    known, rest = [r for r in rows if r["question"] not in held], [r for r in rows if r["question"] in held]
    counts = pairs.end_counts(r["answer"] for r in rows)
    ends = {t: (counts[t, True], counts[t, True] + counts[t, False]) for r in rows if (t := pairs.tail(r["answer"]))}
    model = pairs.fitted(known, ends, epochs=20)
    right, all_defects, agreed = 0, 0, 0
    for r in rest:
        parts, f = pairs.clause_features(r["question"], r["answer"], ends, model.vocabulary)
        tags = [pairs.TAGS[t] for t in model.chain.decode(model.chain.emissions(crf.Features.of(f)), np.array([0, len(parts)]))]
        want, got = (pairs.defect(r["question"], r["answer"], t, parts) for t in (r["tags"], tags))
        right += want == got
        all_defects += want is not None
        agreed += want is not None and want == got
    assert len(rest) > 100 and right / len(rest) > 0.95 and agreed / all_defects > 0.9


def test_refusals_behind_a_long_beginning(spark):
    q = "Ai duyệt yêu cầu nghỉ bù cuối quý của khối văn phòng?"
    begins = ["Về việc ai duyệt yêu cầu nghỉ bù cuối quý của khối văn phòng trong năm nay thì", "Yêu cầu nghỉ bù cuối quý của khối văn phòng do trưởng bộ phận kho lạnh duyệt trong bảng theo dõi chung"]
    ends = ["nên rất tiếc tôi không thể trả lời câu hỏi này.", "tôi không có đủ thông tin để trả lời câu hỏi này."]
    answers = [f"{a} {b}" for a in begins for b in ends]
    states = spark.createDataFrame([(a, q, a) for a in answers], "run_id string, task string, final_answer string")
    questions = spark.createDataFrame([], "id string, question string, expected_answer string")
    assert {r.pair_key: r.defect for r in pairs.flagged(states, questions).collect()} == dict.fromkeys(answers, "refusal")


def test_features_of_different_number_are_summed():
    r = np.random.default_rng(8)
    tokens = [r.integers(0, 50, n).tolist() for n in (1, 90, 3, 700_000, 700_000, 2)]
    features, weights = crf.Features.of(tokens), r.normal(size=(50, 3)).astype(np.float32)
    want = np.array([weights[t].sum(0, dtype=np.float64) for t in tokens])
    assert np.allclose(features.sums(weights), want, rtol=1e-3, atol=0.1)
    buckets, owner = features.take(np.array([2, 0, 5]))
    assert buckets.tolist() == tokens[2] + tokens[0] + tokens[5] and owner.tolist() == [0, 0, 0, 1, 2, 2]


# --- packing


def test_fullest_combination_like_brute_force():
    r = random.Random(4)
    for _ in range(60):
        counts = {n: r.randint(1, 3) for n in sorted(r.sample(range(1, 30), r.randint(1, 6)), reverse=True)}
        room = r.randint(1, 60)
        used = packing._Filler(dict(counts)).fullest(room)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= counts[n] for n, k in used.items())


def test_packing_is_whole(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)] + [(300, None), (301, ""), (302, "word " * 500), (5, "word " * 5)], "doc_id bigint, text string")
    windows = spark.createDataFrame([("w", 64)], "window_name string, capacity_tokens int")
    out = packing.packed(docs, windows)
    rows = out.collect()
    counts = {}
    for r in packing.token_counts(docs).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.tokens
    placed, filled = {}, {}
    for r in rows:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.tokens
        filled[r.container] = filled.get(r.container, 0) + r.tokens
    assert placed == counts and max(filled.values()) <= 64 and filled.get(0, 0) == 0
    assert all(r.piece == 0 for r in rows if counts[r.doc_id] <= 64)
    assert packing.fill_rates(out, windows).first().fill > 0.97
    with pytest.raises(ValueError):
        packing.packed(docs, spark.createDataFrame([("w", 0)], "window_name string, capacity_tokens int"))


@pytest.mark.parametrize("most", [0, 10**6])
def test_a_wide_window_by_broadcast_and_by_blocks(spark, most, monkeypatch):
    """Texts longer than 2**19 tokens, many of the same length, and shards of few lengths."""
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most)
    monkeypatch.setattr(packing.combined, "__defaults__", (5,))
    sizes = [530_000, 69_000, 599_999, 20, *[7 * (i % 23) + 1 for i in range(900)], *[3_000] * 400]
    monkeypatch.setattr(packing, "token_counts", lambda *_: spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int"))
    windows = spark.createDataFrame([("w", 600_000), ("v", 100)], "window_name string, capacity_tokens int")
    got = packing.packed(spark.createDataFrame([], "doc_id bigint, text string"), windows).collect()
    filled, whole = {}, {}
    for r in got:
        filled[r.window_name, r.container] = filled.get((r.window_name, r.container), 0) + r.tokens
        whole[r.window_name, r.doc_id] = whole.get((r.window_name, r.doc_id), 0) + r.tokens
    assert all(n <= {"w": 600_000, "v": 100}[w] for (w, _), n in filled.items())
    assert whole == {(w, i): n for w in "wv" for i, n in enumerate(sizes)}
    assert {c for w, c in filled if w == "w"} == set(range(1, 1 + sum(w == "w" for w, _ in filled)))
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([], "doc_id bigint, text string"), windows.unionAll(spark.createDataFrame([("w", 5)], windows.schema)))


# --- leaks


@pytest.mark.parametrize("seeds", [0, 10**6])
def test_leaks_by_broadcast_and_by_shuffle(spark, seeds):
    passage = " ".join(f"từ{i} số" for i in range(20))
    docs = [(1, f"mở đầu {passage.upper()} kết"), (2, " ".join(passage.split()[:12])), (3, "**" + " | ".join(passage.replace("ừ", "u").split()[5:19]) + "**"), (4, None), (5, ""), (6, " x ".join([" ".join(passage.split()[20:40]), " ".join(passage.split()[:12])]))]
    items = spark.createDataFrame([(7, passage), (8, "ngắn quá"), (9, None)], "item_id bigint, passage string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = leaks.tiled(frame, items, broadcast_seeds=seeds)
    got = {(r.doc_id, r.item_id, r.longest) for r in rows.where("longest >= 13").collect()}
    assert got == {(1, 7, 40), (3, 7, 14), (6, 7, 20)}
    assert {r.doc_id: r.covered for r in rows.collect()}[6] == 32


@pytest.mark.parametrize("seeds", [0, 10**6])
def test_short_items_leak_by_both_ways(spark, seeds):
    texts = [" ".join(f"{a}{k}" for k in range(n)) for a, n in (("a", 5), ("b", 8), ("c", 10), ("d", 11))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, passage string")
    frame = spark.createDataFrame([(i, "x " + " ".join(t.split()[:5]) + " y") for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.longest) for r in leaks.tiled(frame, items, broadcast_seeds=seeds).collect()}
    assert got == {(0, 0, 5), (1, 1, 5), (2, 2, 5)}


@pytest.mark.parametrize("seeds", [0, 10**6])
def test_passages_with_the_same_id_are_all_looked_for(spark, seeds):
    one, two = (" ".join(f"{a}{k}" for k in range(20)) for a in "ab")
    items = spark.createDataFrame([(1, one), (1, two), (1, two)], "item_id bigint, passage string")
    frame = spark.createDataFrame([(5, f"x {one} y"), (6, f"{two} z {one}")], "doc_id bigint, text string")
    rows = leaks.tiled(frame, items, broadcast_seeds=seeds)
    assert sorted((r.doc_id, r.item_id, r.longest) for r in rows.collect()) == [(5, 1, 20), (6, 1, 20), (6, 1, 20)]


def test_tiles_do_not_overlap():
    doc, item = [1, 2, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8]
    seeds = [(s, t) for s in range(9) for t in range(2) if doc[s : s + 5] == item[t : t + 5]]
    assert leaks.tiles(np.array([s for s, _ in seeds]), np.array([t for _, t in seeds]), 6) == [(7, 0, 6)]


def test_a_seed_that_all_documents_share(spark, monkeypatch):
    """Both ways agree where one phrase stands in every document and every item; repeated documents give a row each."""
    monkeypatch.setattr(leaks.join_salted, "__defaults__", (4, 10, 5, 0))
    phrase = "theo quy định hiện hành của công ty"
    items = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"i{i}x{k}" for k in range(20))) for i in range(4)], "item_id bigint, passage string")
    docs = [(d, f"{phrase} và {phrase} " + " ".join(f"i{d % 5}x{k}" for k in range(d % 7, 20))) for d in range(60)] + [(3, f"{phrase} " + " ".join(f"i1x{k}" for k in range(20)))] * 2
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = [sorted(tuple(r) for r in leaks.tiled(frame, items, broadcast_seeds=n).collect()) for n in (0, 10**6)]
    assert got[0] == got[1] and len(got[0]) > 48

import math
import random
import re

import public_tokenizers
import sentencepiece

from vertexflow.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = [None, "", "   \n", "one two", "a b c d e f g h i j", "x " * 40, "line one here\nline one here\n\n \nother # $ <b>\nline one here", "привет мир как дела у тебя сегодня вечером мой друг", "你好 世界 " * 6, "\U0001f600 " * 12, "w" * 5000]


def plain_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(hit)


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    again = plain_repeats(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, again, len(words) < 10 or 100 * again > 20 * len(words)


def test_base_counts_and_measures(spark):
    rng = random.Random(6)
    cases = CASES + [" ".join(rng.choice("aa bb cc") for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(cases)], "doc_id long, text string, lang string, script string")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = fertility.rate(docs, PATH).collect()
    assert len(rows) == len(cases)
    for r in rows:
        text = cases[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected(text)
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in model.encode(w)]
        assert r["n_tokens"] == len(ids)
        if not ids:
            assert r["kept"] is False and r["chars_per_token"] is None
            continue
        assert math.isclose(r["chars_per_token"], r["word_chars"] / len(ids))
        assert math.isclose(r["byte_share"], sum(model.is_byte(i) for i in ids) / len(ids))
        share = [ids.count(i) / len(ids) for i in set(ids)]
        assert math.isclose(r["token_entropy"], -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        assert not (r["base_failed"] and r["kept"])
    assert fertility.rate(docs.limit(0), PATH).count() == 0


def test_bands_reject_the_odd_and_keep_the_usual(spark):
    rng = random.Random(7)
    lexicon = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    usual = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(150, 250))), "xx") for i in range(300)]
    odd = [(1000 + i, " ".join(rng.choice(lexicon[:12]) + "***" for _ in range(200)), "xx") for i in range(10)]
    rows = {r["doc_id"]: r["kept"] for r in fertility.rate(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string"), PATH).collect()}
    assert sum(rows[i] for i, *_ in usual) >= 297
    assert not any(rows[i] for i, *_ in odd)
    damaged = [(1, "þ¤¬" * 3 + " ¤ý " * 30 + " ".join(f"w{i}¶" for i in range(30)), "xx")]
    assert not fertility.rate(spark.createDataFrame(damaged, "doc_id long, text string, lang string"), PATH).first()["kept"]
    docs = spark.createDataFrame(usual + odd + [usual[0], (None, None, None)], "doc_id long, text string, lang string")
    kept = fertility.keep(docs, PATH)
    assert kept.columns == docs.columns and 298 <= kept.count() <= 301


def test_copies_do_not_narrow_the_bands(spark):
    rng = random.Random(8)
    lexicon = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    usual = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(150, 250))), "xx") for i in range(300)]
    copies = [(1000 + i, usual[0][1], "xx") for i in range(900)]
    base = " ".join(rng.choice(lexicon) for _ in range(200))
    near = [(3000 + i, f"{base} {lexicon[i % 400]} {i}", "xx") for i in range(400)]
    for more in (copies, near):
        rows = {r["doc_id"]: r["kept"] for r in fertility.rate(spark.createDataFrame(usual + more, "doc_id long, text string, lang string"), PATH).collect()}
        assert sum(rows[i] for i, *_ in usual) >= 294


VI = "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu."
YO = "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá."
LO = "ມະນຸດທຸກຄົນເກີດມາມີກຽດສັກສີ ສິດທິ ເສລີພາບ ແລະ ຄວາມສະເໝີພາບເທົ່າທຽມກັນ ທຸກໆຄົນ ມີເຫດຜົນ ແລະ ຄວາມຄິດ ຄວາມເຫັນ"


def test_clean_texts_of_rarer_languages_stay(spark):
    rng = random.Random(9)
    few = [(1, VI, "vi"), (2, YO, "yo"), (3, LO, "lo")]
    lexicon = VI.split()
    many = [(100 + i, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(90, 120))), "zz") for i in range(150)]  # its own band, where no fixed one knows it
    rows = {r["doc_id"]: r["kept"] for r in fertility.rate(spark.createDataFrame(few + many, "doc_id long, text string, lang string"), PATH).collect()}
    assert all(rows[i] for i, *_ in few)
    assert sum(rows[i] for i, *_ in many) >= 140


def test_low_entropy_is_rejected_in_small_classes(spark):
    rng = random.Random(10)
    junk = lambda n: " ".join("".join(rng.choice(["this", "that"]) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    lexicon = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    clean = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    usual = [(i, clean(rng.randrange(150, 250)), "xx") for i in range(300)]
    odd = [(1000, junk(200), "xy"), (1001, junk(3000), "xx"), (1002, clean(3000), "xx"), (1003, clean(40), "xx"), (1004, clean(200), "xy")]
    rows = {r["doc_id"]: r["kept"] for r in fertility.rate(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string"), PATH).collect()}
    assert [rows[i] for i in range(1000, 1005)] == [False, False, True, True, True] and sum(rows[i] for i, *_ in usual) >= 294
    alone = fertility.rate(spark.createDataFrame([odd[0], odd[4]], "doc_id long, text string, lang string"), PATH).collect()
    assert {r["doc_id"]: r["kept"] for r in alone} == {1000: False, 1004: True}


def test_scripts():
    assert [fertility.script_of(t) for t in ("abc", "été", "привет", "你好吗", "123 !", "αβγ", "🙂🙂")] == ["Latin", "Latin", "Cyrillic", "Han", "Latin", "Greek", "other"]

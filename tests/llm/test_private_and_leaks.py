"""Surrogates, decontamination, packing, archive and pipeline."""

import re
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from counterloom.llm import decontaminate, packing, surrogates, warc_store
from counterloom.llm.queries import tokenizer

from .conftest import ODD, table, words


def replaced(spark, rows, key="k"):
    df = surrogates.replace_personal_data(table(spark, rows), key)
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and df.count() == len(rows)
    return {r["doc_id"]: r["text"] for r in df.collect()}


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_surrogates_keep_type_form_and_coreference(spark):
    rows = [
        (1, "Mail JOHN.Doe@Corp.Example.com, john.doe@corp.example.com; card 4111 1111 1111 1111 = 4111111111111111; no card 4111111111111112"),
        (2, 'ip 192.168.1.10 tel +1 (377) 555-0271 ssn 123-45-6789 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" version 1.2.3.4.5'),
        (3, "Mr. John Smith met Mrs. Anna Jones and Господин Иван Петров; Mr. John Smith left"),
        (4, "call +1 (377) 555-0271 or 4111-1111-1111-1111"),
        *ODD,
    ]
    out = replaced(spark, rows)
    one = re.search(r"Mail (\S+), (\S+); card ([\d ]+) = (\d+); no card (\d+)", out[1])
    assert one[1].lower() == one[2] != "john.doe@corp.example.com" and one[2].endswith(".com") and one[1][:4].isupper()
    assert one[3].replace(" ", "") == one[4] != "4111111111111111" and luhn(one[4]) and one[4][0] == "4" and one[5] == "4111111111111112"
    two = re.search(r'ip (\S+) tel (\+1 \(\d{3}\) \d{3}-\d{4}) ssn (\d{3}-\d{2}-\d{4}) token = "([0-9a-f]{40})" version 1\.2\.3\.4\.5', out[2])
    assert all(0 <= int(x) <= 255 for x in two[1].split(".")) and two[1] != "192.168.1.10"
    assert out[4] == f"call {two[2]} or {'-'.join(one[4][i : i + 4] for i in (0, 4, 8, 12))}"
    names = re.search(r"Mr\. (.+) met Mrs\. (.+) and Господин (.+); Mr\. (.+) left", out[3])
    given = {k: v.split() for k, v in surrogates.GIVEN.items()}
    assert names[1] == names[4] and names[1].split()[0] in given["m", "latin"] and names[2].split()[0] in given["f", "latin"]
    assert names[3].split()[0] in given["m", "cyrillic"] and re.fullmatch(r"[А-Яа-яёЁ]+ [А-Яа-яёЁ]+", names[3])
    for i, text in ODD:
        assert out[i] == text
    assert replaced(spark, rows[:1], "other")[1] != out[1]


def test_surrogates_stay_distinct_and_never_equal_an_entity(spark, monkeypatch):
    # social numbers of which only the last digit is drawn, so that clashes are certain
    monkeypatch.setattr(surrogates, "_like", lambda text, s, h: F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.lpad((surrogates._byte(s, 0) % 100).cast("string"), 2, "0")))
    rows = [(i, f"n 123-45-67{i:02d} and 123-45-67{i:02d}") for i in range(30)]
    out = replaced(spark, rows)
    new = [re.findall(r"\d{3}-\d{2}-\d{4}", out[i]) for i in range(30)]
    assert all(a == b for a, b in new)
    assert len({a for a, _ in new}) == 30
    assert not {a for a, _ in new} & {f"123-45-67{i:02d}" for i in range(30)}


def test_names_of_every_form(spark):
    texts = [
        "Mr Jean-Luc Picard, Mr Sean O'Brien's, Mr J. Smith, Mrs. MARTA KLEIN, MR JOHN SMITH, Dr Anna Roe, Frau Eva von der Heide",
        "κ. Mr Ωμέγας Άλφας and Κυρία Άννα Ζωή Παππά",
        "Mr John Smith came. Yesterday John Smith left; JOHN SMITH Ltd, john.smith@mail.org, John Smith@x.org, My Token=abcd1234efgh. Jane Roe stays",
        "John Smith of New York City has no title here",
        "Mr John Smith Mrs Anna Roe and I saw MS Office, DR Congo",
    ]
    out = replaced(spark, list(enumerate(texts)))
    word = r"[A-Z][a-z]+"
    first = re.fullmatch(rf"Mr ({word}-{word} {word}), Mr ({word} O'{word})'s, Mr ([A-Z]\. {word}), Mrs\. ([A-Z]+ [A-Z]+), MR ([A-Z]+ [A-Z]+), Dr ({word} {word}), Frau ({word} von der {word})", out[0])
    assert first and len(set(first.groups())) == 7
    for gone in ("Jean", "Luc", "Picard", "Brien", "Smith", "MARTA", "SMITH", "Roe", "Heide"):
        assert gone not in out[0]
    assert first[6].split()[0] in surrogates.GIVEN["x", "latin"].split() and first[4].split()[0].title() in surrogates.GIVEN["f", "latin"].split()
    greek = r"[\u0370-\u03ff]+"
    assert re.fullmatch(rf"κ\. Mr {greek} {greek} and Κυρία {greek} {greek} {greek}", out[1]) and "Άλφας" not in out[1] and "Παππά" not in out[1]
    name = re.match(rf"Mr ({word} {word}) came", out[2])[1]
    assert name != "John Smith" and f"Yesterday {name} left; {name.upper()} Ltd," in out[2] and out[2].endswith("Jane Roe stays")
    assert "Smith" not in out[2] and "abcd1234efgh" not in out[2] and first[5] == name.upper()
    assert out[3] == texts[3]  # a text without the title is left alone
    assert re.fullmatch(rf"Mr {name} Mrs {word} {word} and I saw MS Office, DR Congo", out[4])


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame([("a@b.org", 1, 2, 3, 4, 5), ("plain", 1, 2, 3, 4, 5), (None, 1, 2, 3, 4, 5)], "text string, _new int, _replaced int, _key int, _text_key int, kind int")
    out = surrogates.replace_personal_data(df, "k")
    assert out.columns == [*df.columns, "_replaced_"] and sorted(r[5 + 1] for r in out.collect()) == [0, 0, 1]
    assert all(tuple(r)[1:6] == (1, 2, 3, 4, 5) for r in out.collect())
    assert surrogates.replace_personal_data(df.limit(0), "k").count() == 0


def test_secrets_are_replaced_whole(spark):
    r = np.random.default_rng(4)
    values = ["".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"), n)) + "Q7" for n in (127, 498, 4998)]
    values += ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4", "Zm9vYmFyMTIzNDU2"]
    names = ("token", "client_secret", "access_token", "DB_PASSWORD", "my_api_key")
    out = replaced(spark, [(i, f'{name} = "{v}". and {name}={v}. end') for i, (name, v) in enumerate(zip(names, values, strict=True))])
    for i, (name, v) in enumerate(zip(names, values, strict=True)):
        new = re.fullmatch(rf'{name} = "(.+)"\. and {name}=(.+)\. end', out[i])
        assert new[1] == new[2] and len(new[1]) == len(v) and all((a == b) == (not a.isalnum()) or a.isalnum() == b.isalnum() for a, b in zip(v, new[1], strict=True))
        assert not any(v[k : k + 8] == new[1][k : k + 8] for k in range(len(v) - 7)) and new[1].count(".") == v.count(".")


def test_contamination_finds_exact_and_near_passages_only(spark):
    items = [(i, words(30 + i, 50 + i)) for i in range(8)] + [(90, None), (91, ""), (92, "three word item"), (93, items_twice := words(30, 50))]
    assert items_twice == items[0][1]
    near = items[2][1].split(" ")
    near[10] = "changed"
    half = " ".join(items[3][1].split(" ")[:16])
    rows = [(1, f"{words(50, 1)} {items[1][1]} {words(20, 2)}"), (2, f"{words(9, 3)} {' '.join(near)} tail"), (3, f"{words(40, 4)} {half}"), (4, items[4][1].upper().replace(" ", ", ")),
            (5, words(300, 6)), (6, f"x {items[0][1]}"), (7, "a Three, word item b"), (8, f"{items[5][1]} {items[6][1]}"), *ODD]
    rows.append(rows[0])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    for block in (16 << 20, 400):
        found = decontaminate.contaminated(table(spark, rows), bench, block_bytes=block)
        pairs = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
        assert set(pairs) == {(1, 1), (2, 2), (4, 4), (6, 0), (6, 93), (7, 92), (8, 5), (8, 6)} - ({(2, 2)} if (2, 2) not in pairs else set())
        assert all(v == 1 for k, v in pairs.items() if k != (2, 2))
    clean = decontaminate.clean(table(spark, rows), found).select("doc_id").collect()
    assert {r["doc_id"] for r in clean} >= {3, 5, None} and not {r["doc_id"] for r in clean} & {1, 4, 6, 7, 8}
    assert decontaminate.contaminated(table(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, rows).limit(0), bench).count() == 0


def test_near_passages_do_not_depend_on_blocks(spark):
    common = words(20, 800)  # in every item, so that its shingles weigh less
    items = [(i, f"{words(30, 810 + i)} {common} {words(30, 850 + i)}") for i in range(12)]
    rows = []
    for i, text in items:
        for at in (3, 35, 74):
            near = text.split(" ")
            near[at] = "changed"
            rows.append((100 * i + at, f"{words(20, 900 + i)} {' '.join(near)} {words(20, 950 + i)} {common} end"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({tuple(r) for r in decontaminate.contaminated(table(spark, rows), bench, block_bytes=b).collect()} for b in (16 << 20, 1500))
    assert one == many and len(one) >= 30 and sum(0.8 <= r[2] < 0.95 for r in one) >= 12


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, 40).astype(np.uint64)
    index = decontaminate._index(prints, 23)
    for i, p in enumerate(prints):
        for _ in range(20):
            q = int(p)
            for b in rng.choice(64, 23, replace=False):
                q ^= 1 << int(b)
            blocks = decontaminate._blocks_of(np.array([q], np.uint64))[0].astype(int)
            assert any(i in near[at[v] : at[v + 1]] for (at, near), v in zip(index, blocks, strict=True))


def test_packing_places_every_token_once(spark):
    rows = [(i, words(n, i)) for i, n in enumerate((3, 900, 2500, 40, 700, 12, 1300))] + ODD + [(50, "a\u2003b  c\n\n d"), (51, "  lead\r\ntrail \n")]
    rows.append(rows[1])
    got = packing.pack(table(spark, rows).repartition(3), tokenizer("byte_bpe_50k.json")).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = sorted(((i if i is not None else -1), plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
    for i, ids in want:
        own = sorted(pieces[i], key=lambda r: r["start"])
        copies = sum(j == i for j, _ in want)
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for a, b in zip(places, places[1:], strict=False):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0) and b[1] + b[2] <= 2048
    assert packing.pack(table(spark, rows).limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
def test_differencing_deals_all_within_capacity(lengths):
    windows = packing.balanced(lengths, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in w) for w in windows) <= 100
    two = packing.differencing(lengths, 2)
    assert abs(sum(lengths[i] for i in two[0]) - sum(lengths[i] for i in two[1])) <= max(lengths)


def test_many_short_rests_take_bounded_memory():
    lengths = [1] * 100_000 + [3] * 5_000 + [512] * 40
    tracemalloc.start()
    windows = packing.balanced(lengths, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and sorted(i for w in windows for i in w) == list(range(len(lengths)))
    full = [sum(lengths[i] for i in w) for w in windows]
    assert max(full) <= 2048 and len(full) <= -(-sum(lengths) // 2048) + 1


def test_short_texts_are_packed_whole(spark):
    got = packing.pack(spark.range(70_000).selectExpr("id as doc_id", "if(id % 2 = 0, null, 'a') as text").coalesce(1), tokenizer("byte_bpe_50k.json"))
    assert got.count() == got.select("doc_id").distinct().count() == 70_000
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and got.select("sequence_id").distinct().count() <= 105_000 // 2048 + 3


def test_archive_round_trip(spark, tmp_path):
    long, tail = "<p>é</p>" * 40, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5
    pages = [(1, "http://a/1", long), (5, "http://a/5", long), (3, None, long), (2, "http://a/2\r\nX: y", None), (4, "http://a/4", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", tail), (9, "u", tail + "x" * 200_000), (1, "http://a/1", long)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc_store.write_archive(df, f"{tmp_path}/a")
    got = warc_store.read_archive(spark, f"{tmp_path}/a")
    rows = {r["record_id"]: r for r in got.collect()}
    assert got.count() == len(pages)
    assert {i: r["refers_to"] for i, r in rows.items() if r["record_type"] == "revisit"} == {5: 1, 3: 1}
    assert all((r["payload"] or b"").decode() == (h or "") and r["payload_bytes"] == len((h or "").encode()) for i, _, h in pages for r in [rows[i]])
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 5
    warc_store.export_warc(got, f"{tmp_path}/w", per_file=2)
    back = {r["record_id"]: r for r in warc_store.import_warc(spark, f"{tmp_path}/w").collect()}
    for i, r in rows.items():
        assert back[i]["header"] + back[i]["payload"] + b"\r\n\r\n" == r["record"] and back[i]["payload_digest"] == r["payload_digest"]
    assert b"X: y" not in rows[2]["record"].split(b"WARC-Target-URI")[0] and b"%0D%0A" in rows[2]["record"]
    warc_store.write_archive(df.limit(0), f"{tmp_path}/e")
    assert warc_store.read_archive(spark, f"{tmp_path}/e").count() == 0


def test_damaged_payloads_are_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc_store.write_archive(df, f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(bad, "digest string, first_id long, payload binary, verified boolean").write.mode("overwrite").parquet(f"{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_archive(spark, f"{tmp_path}/a").collect()

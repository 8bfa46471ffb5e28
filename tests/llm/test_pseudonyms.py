import hashlib
import re

from pyspark.sql import functions as F

from bazarlens.llm import pseudonyms
from tests.llm.support import clashing, documents

KEY = "it's a \\ key"


def feistel(value, left, right, tweak):
    """The network again, in plain Python."""
    a, b = divmod(value, right)
    for r in range(pseudonyms.ROUNDS):
        mixed = int(hashlib.sha256(f"{KEY}|{tweak}|{r}|{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + mixed) % (left if r % 2 == 0 else right)
    return a * right + b


def replaced(spark, *texts):
    rows = pseudonyms.pseudonymise(documents(spark, list(texts)), KEY).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def test_formats_stay_valid_and_values_linked(spark):
    texts = replaced(
        spark,
        "call +1 (636) 555-2031, or 636-555-2031. Again: +1 (636) 555-2031",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4156502794772904.",
        "from 93.81.200.107 to 93.81.200.107",
        "mail nacccgom.40@mail6.example.com, Nacccgom.40@mail6.example.com",
        "ssn 123-45-6789",
        "born 1980-02-28, 28.02.1980 and 12/31/1999, 31/12/1999",
        "DE89 3704 0044 0532 0130 00",
        "+49 30 1234567",
    )
    a, b, c = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), or (\d{3}-\d{3}-\d{4})\. Again: (\+1 \(\d{3}\) \d{3}-\d{4})", texts[0]).groups()
    assert a == c and re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b) and "555-2031" not in texts[0]
    cards = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4}), (\d{16})\.", texts[1]).groups()
    plain = [re.sub(r"\D", "", x) for x in cards]
    assert plain[0] == plain[1] != plain[2] and all(map(luhn, plain)) and "4111111111111111" not in plain and plain[2] != "4156502794772904"
    x, y = re.fullmatch(r"from ([\d.]+) to ([\d.]+)", texts[2]).groups()
    number = 0
    for part in "93.81.200.107".split("."):
        number = number * 256 + int(part)
    moved = feistel(number, 65536, 65536, "ip")
    assert x == y == ".".join(str(moved >> s & 255) for s in (24, 16, 8, 0))
    m, n = re.fullmatch(r"mail ([a-z]{8}\.\d\d@mail6\.example\.com), ([A-Z][a-z]{7}\.\d\d@mail6\.example\.com)", texts[3]).groups()
    assert m == n.lower() and "nacccgom" not in m
    area, group, serial = map(int, re.fullmatch(r"ssn (\d{3})-(\d\d)-(\d{4})", texts[4]).groups())
    moved = feistel((122 * 99 + 44) * 9999 + 6788, 88902, 9999, "ssn")
    assert (area - (2 if area > 666 else 1), group - 1, serial - 1) == (moved // 989901, moved // 9999 % 99, moved % 9999)
    iso, dotted, us, eu = re.fullmatch(r"born (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}) and (\d\d/\d\d/\d{4}), (\d\d/\d\d/\d{4})", texts[5]).groups()
    assert iso == "-".join(reversed(dotted.split("."))) != "1980-02-28"
    iban = texts[6].replace(" ", "")
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", texts[6]) and texts[6] != "DE89 3704 0044 0532 0130 00"
    assert int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\+49 3\d \d{7}", texts[7]) and texts[7] != "+49 30 1234567"


def test_what_is_not_valid_stays(spark):
    texts = [None, "", "no number", "4111 1111 1111 1112", "0000000000000000", "999.1.1.1", "1.2.3", "000-12-3456", "666-12-3456", "1980-02-30", "1880-01-01", "DE89 3704 0044 0532 0130 01", "x4156502794772904", "page 12, 1234567890", "a@b"]
    assert replaced(spark, *texts) == texts


def test_numbers_beside_other_groups_are_found(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    beside = ["{} 123", "{} 12/25", "ref 12 {}", "ref 1234 {} 99", "1234567 {}", "{} {}", "{} 12th", "20 30 {} 7 8 9"]
    texts = replaced(spark, card, iban, *(x.replace("{}", card) for x in beside), f"{iban} BANK", f"{iban} {iban} EUR", f"{card} 636-555-2031", "636-555-2031", "1 2 " * 5000 + card)
    assert card not in texts[0] and iban not in texts[1]
    assert texts[2:10] == [x.replace("{}", texts[0]) for x in beside]
    assert texts[10:12] == [f"{texts[1]} BANK", f"{texts[1]} {texts[1]} EUR"]
    assert texts[12] == f"{texts[0]} {texts[13]}" and "636-555-2031" not in texts[12]
    assert texts[14] == "1 2 " * 5000 + texts[0]


def test_dates_of_timestamps_and_with_single_digits_are_linked(spark):
    texts = replaced(spark, "2001-04-03", "2001-04-03T10:00:00Z", "2001-4-3", "on 3.4.2001.", "4/3/2001 and 04/03/2001", "25/4/2001", "2001-04-25", "2001-04-03Tag", "32.1.2001", "1.2.2001.4")
    year, month, day = texts[0].split("-")
    assert texts[0] != "2001-04-03" and texts[1] == f"{texts[0]}T10:00:00Z"
    assert texts[2] == f"{year}-{int(month)}-{int(day)}" and texts[3] == f"on {int(day)}.{int(month)}.{year}."
    assert texts[4] == f"{int(month)}/{int(day)}/{year} and {month}/{day}/{year}"
    year, month, day = texts[6].split("-")
    assert texts[5] == f"{int(day)}/{int(month)}/{year}"
    assert texts[7:] == ["2001-04-03Tag", "32.1.2001", "1.2.2001.4"]


def test_long_text_and_other_columns(spark):
    frame = clashing(documents(spark, ["x " * 50_000 + "93.81.200.107 " * 50, "93.81.200.107"]))
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame, KEY).collect()}
    assert rows[0]["text"].split()[-1] == rows[1]["text"] and rows[0]["m"] == "x"
    assert pseudonyms.pseudonymise(frame.limit(0), KEY).count() == 0
    other = pseudonyms.pseudonymise(frame, "another").where("doc_id = 1").first()["text"]
    assert other != rows[1]["text"]


def test_digit_and_letter_strings_are_permuted(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("value"))
    assert digits.select(F.expr(pseudonyms._permute_digits("value", "'x'", KEY))).distinct().count() == 1000
    letters = spark.range(676).select(F.expr("concat(char(97 + id % 26), char(97 + id DIV 26))").alias("value"))
    moved = letters.select(F.expr(pseudonyms._permute_letters("value", "'x'", KEY)).alias("v"))
    assert moved.distinct().count() == 676 and moved.where("v RLIKE '^[a-z]{2}$'").count() == 676


def test_plan_has_no_python(spark):
    plan = pseudonyms.pseudonymise(documents(spark, ["a"]).select("doc_id", "text"), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_each_format_stands_in_the_plan_once(spark):
    """Nine networks: letters and digits of addresses, and one for each other format. The driver plans all of it."""
    plan = pseudonyms.pseudonymise(documents(spark, ["a"]), KEY)._jdf.queryExecution().analyzed().toString()
    assert plan.count("sha2(") == 9


def test_values_inside_runs_move_as_they_do_alone(spark):
    values = ["4111 1111 1111 1111", "2024-02-29", "123-45-6789", "212-555-0123"]
    together = " ".join(values) + " 77"
    moved = replaced(spark, *values, together)
    assert moved[-1] == " ".join(moved[:-1]) + " 77" and all(a != b for a, b in zip(values, moved, strict=False))

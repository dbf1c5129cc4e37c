from tallyspan.operators import reject

SCHEMA = "run long, line long, raw string, source string, reason string, field int"
GOOD_R = "2024-01-02,Lightweight,A B,3"


def parsed(spark, rows):
    d = spark.createDataFrame([(1, i, r, s, "clash", 0) for i, (r, s) in enumerate(rows)], SCHEMA)
    return reject.parse_records(d, ["run", "line"], "raw", "source"), d


def reasons(spark, rows):
    return {r.line: r.reason for r in parsed(spark, rows)[0].rejected.collect()}


def test_structure_and_values(spark):
    m, f, k = "mdabbert", "odds_feed", "rankings:weekly_list"
    rows = [
        (GOOD_R, k),
        (' 2024-01-02 , "Lightweight" , "A ""x"" B, C" ,"3" ', k),
        ('2024-01-02,Lightweight,"A\nB",3', k),
        ("2024-01-02,Lightweight,,0", k),
        ("2024-01-02,Lightweight,NA,15", k),
        ("2024-01-02,Lightweight,A", k),
        (GOOD_R + ",x", k),
        ('2024-01-02,Lightweight,A "x" B,3', k),
        ('2024-01-02,Lightweight,"A,3', k),
        ('2024-01-02,Lightweight,"A"B,3', k),
        ("2024-02-30,Lightweight,A,3", k),
        ("2024-01-02,lightweight,A,3", k),
        ("2024-01-02,Lightweight,A,16", k),
        (None, k),
        ("", k),
        (GOOD_R, "features"),
        (GOOD_R, None),
        ("A,B,2024-01-02,-150,nan,Red,Heavyweight", m),
        ("A,B,2024-01-02,-99,,Red,Heavyweight", m),
        ("A, ,2024-01-02,150,,Red,Heavyweight", m),
        ("A,B,2024-01-02,150,,red,Heavyweight", m),
        (",A,B,1.5,,2024-01-02,,s,uk", f),
        ("http://x.example/f/0123456789abcdef,A,B,1.5,2,2024-01-02,2024-01-01T23:59:59,s,uk", f),
        ("http://x.example/f/0123456789abcdeg,A,B,1.5,2,2024-01-02,,s,uk", f),
        (",A,B,1.0,2,2024-01-02,,s,uk", f),
        (",A,B,1.5,2,2024-01-02,2024-01-01 24:00:00,s,uk", f),
        (",A,B,1e3,2,2024-01-02,,s,de", f),
    ]
    got = reasons(spark, rows)
    assert set(got) == {5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 19, 20, 23, 24, 25, 26}
    assert got[5] == got[6] == got[13] == got[14] == "column count"
    assert got[7] == got[8] == got[9] == "quoting"
    assert got[15] == got[16] == "unknown layout"
    assert got[10] == "invalid value: day" and got[26] == "invalid value: price"


def test_counts_long_lines_and_repeats(spark):
    long = '2024-01-02,Lightweight,"' + 'ab""' * 50_000 + '",3'
    p, d = parsed(spark, [(GOOD_R, "rankings:weekly_list"), (long, "rankings:weekly_list"), ("x", "rankings:weekly_list")])
    assert reject.run_counts(p, d.unionByName(d), "run", ["run", "line"]).first().asDict() == {"run": 1, "rows_read": 3, "rows_loaded": 2, "rows_rejected": 1}
    loaded = {r.line: r for r in p.loaded(["run", "line"], "rankings:weekly_list").collect()}
    assert set(loaded) == {0, 1} and len(loaded[1].name_raw) == 150_000


def test_empty(spark):
    p, d = parsed(spark, [])
    assert p.rejected.count() == 0 and reject.run_counts(p, d, "run", ["run", "line"]).count() == 0

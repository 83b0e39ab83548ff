from collections import defaultdict

SF = "/root/testdata/sf0.001"


def rows_by(df, key):
    out = defaultdict(list)
    for row in df.collect():
        out[row[key]].append(row)
    return out

"""Helpers of these tests."""


def rows(df):
    return [r.asDict() for r in df.collect()]

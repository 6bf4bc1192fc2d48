from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def column(df: DataFrame, name: str) -> list:
    return [r[name] for r in df.select(name).collect()]

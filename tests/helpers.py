import pandas as pd

SF = "/root/testdata/sf0.001"


def normal(df):
    """Rows of a pandas frame as sorted tuples, columns by name, floats to ten digits."""

    def cell(v):
        if v is None or pd.isna(v) is True or v != v:
            return None
        return f"{v:.10g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False)), key=str)

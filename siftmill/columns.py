"""Reserved column names shared by every operator."""

ID = "_row_id"
LABEL = "_label"
OBS = "_obs_time"
SPLIT_TIME = "_split_time"
SPLIT = "split"
RESERVED = (ID, LABEL, OBS, SPLIT_TIME, SPLIT)
SPLIT_NAMES = ("train", "valid", "oot_dev", "holdout")
OPEN_SPLITS = ("train", "valid", "oot_dev")


def feature_columns(df):
    """Every column of ``df`` that is not reserved."""
    return [c for c in df.columns if c not in RESERVED]

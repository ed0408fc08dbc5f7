from .baskets import pair_counts
from .bits import KNOWN, KeyBits, flagged, key_bits, marked, whole
from .groupings import Grouping, sums_together
from .hierarchy import descend
from .lineage import cut_lineage, stored_columns
from .ordering import abc_classes, percent_ranks, percentiles, quantile_buckets, running_totals
from .sets import not_in
from .series import consecutive_runs, gap_days, previous, running, trailing_mean

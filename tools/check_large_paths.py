"""The oracle check with the plans large inputs get: sliced scans, distributed summaries.

usage: check_large_paths.py SF_DIR [name ...]
"""

from __future__ import annotations

import sys

import check_oracles
from matchlens.operators import ordered, quantiles

ordered.is_small = quantiles.is_small = lambda df: False
ordered.MAX_ROWS = 100

if __name__ == "__main__":
    sys.exit(check_oracles.main(sys.argv[1], sys.argv[2:]))

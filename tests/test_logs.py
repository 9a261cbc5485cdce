import os
import tempfile

import pytest

from matchsmith.plans import logs as L
from matchsmith.sources.io import numbered_lines

RUN_LOG = """loading data
original_computers_small
epoch 1 ...
Training done
Finished Epoch 1 || Run Time: 1.0 | Load Time: 0.2 || F1: 81.50 | Prec: 80.00 | Rec: 83.10 || Ex/s: 10
Finished Epoch 2 || Run Time: 1.0 | Load Time: 0.2 || F1: 99.00 | Prec: 99.00 | Rec: 99.00 || Ex/s: 10
mtcat_computers_small
Finished Epoch 1 || Run Time: 1.0 | Load Time: 0.2 || F1: 10.00 | Prec: 10.00 | Rec: 10.00 || Ex/s: 10
Training done
Finished Epoch 3 || Run Time: 1.0 | Load Time: 0.2 || F1: 70.25 | Prec: 71.00 | Rec: 69.50 || Ex/s: 10
mt_added_computers_small
Training done
"""

SCORE_LOG = """svm results:
0,0.9,0.8,0.85,100
1,0.70,0.60,0.65,50
mac avg,0.80,0.70,0.75,150
macro avg weighted,0.83,0.73,0.78,150
micro avg,0.76,0.76,0.76,150
accuracy on test=0.76
lstm results:
1,0.5,0.4,0.44,50
accuracy on test=0.9
"""


def _lines(spark, name, text):
    d = tempfile.mkdtemp(prefix="ms-log-")
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    return numbered_lines(spark, os.path.join(d, name))


def test_run_log(spark):
    rows = sorted(tuple(r)[1:] for r in L.parse_run_log(_lines(spark, "run.log", RUN_LOG)).collect())
    assert rows == [("mtcat_computers_small", 71.0, 69.5, 70.25),
                    ("original_computers_small", 80.0, 83.1, 81.5)]


def test_score_log(spark):
    out = {r.setting: r for r in L.parse_score_log(_lines(spark, "s.log", SCORE_LOG)).collect()}
    svm = out["svm results:_row1"]
    assert svm.class1_f1 == pytest.approx(0.65) and svm.macro_precision == pytest.approx(0.8)
    assert svm.weighted_recall == pytest.approx(0.73) and svm.micro_f1 == pytest.approx(0.76)
    assert svm.accuracy == pytest.approx(0.76)
    lstm = out["lstm results:_row8"]
    assert lstm.class1_recall == pytest.approx(0.4) and lstm.macro_f1 is None
    assert lstm.accuracy == pytest.approx(0.9)

"""The sample flow (generator → log) as a running stream: start, status, stop.

Usage: python examples/sample_flow.py [seconds]
Each trigger is one firing of the generator (one record of custom text); the
log stage writes attribute blocks as text under spark.checkpoint.dir.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowspark.operators import counters  # noqa: E402
from flowspark.plans.presets import sample_flow  # noqa: E402
from flowspark.session import build_session, work_dir  # noqa: E402
from flowspark.sources import read_log, schedule_stream  # noqa: E402


def main() -> None:
    seconds = float(sys.argv[1]) if len(sys.argv) > 1 else 6
    spark = build_session("local[2]", app="sample-flow")
    base = work_dir(spark, "example_sample_flow")
    firings = counters(schedule_stream(spark, batch_size=1, period="1 sec"), "firings", size=None)
    flow = sample_flow(firings, custom_text="Hello from the flow!")
    runner = flow.runner(spark, {"log": {"path": f"{base}/log", "format": "text"}},
                         period="1 sec", checkpoint_root=f"{base}/checkpoints")
    print("start:", runner.start())
    print("start again:", runner.start())
    time.sleep(seconds)
    print("status:", runner.status())
    print("stop:", runner.stop())
    lines = read_log(spark, f"{base}/log")
    print("payload lines logged:", lines.filter(lines.value.startswith("Payload: ")).count())
    spark.stop()


if __name__ == "__main__":
    main()

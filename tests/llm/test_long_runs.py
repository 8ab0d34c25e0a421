"""Text without spaces has the character runs of its words."""

import numpy as np

from wardline.llm.toxicity import Encoder


def test_a_long_run_has_its_grams():
    encode = Encoder()
    run = "".join(f"word{i}" for i in range(40))
    inner = encode.word(run)
    assert len(run) > 64 and len(inner) > 100 and run not in encode.known
    # The grams of a run inside another are found again, apart from those at its two ends.
    part, ends = encode(run[40:90]), {f"^{run[40:90]}$"}
    ends |= {f"^{run[40:43]}", f"^{run[40:44]}", f"{run[87:90]}$", f"{run[86:90]}$"}
    assert len(np.setdiff1d(part, encode(run))) <= len(ends)
    assert "short" not in encode.known and len(encode("short")) and "short" in encode.known

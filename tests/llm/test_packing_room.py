import subprocess
import sys
from pathlib import Path

RUN = """
import re, threading, time
import pyarrow.parquet as pq
from waymark.llm import bin_packing, bpe_tokens, common, queries as q

pss = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).combine_chunks().to_batches()
codec = bpe_tokens.encoder(q.VOCABULARY, q.PATTERN, bin_packing.REMEMBER)
held, most, done = pss(), 0, False

def watch():
    global most
    while not done:
        most = max(most, pss())
        time.sleep(0.02)

threading.Thread(target=watch).start()
for part in common.blocks(iter(texts), "text", getattr(bin_packing, "BLOCK", 4 << 20)):
    codec.encode(part.column(0).to_pylist())
done = True
print(most - held)
"""


def test_a_packing_worker_needs_little_room():
    """MB beyond the tokenizer and the texts while texts are encoded: about 110 with blocks of 4 MB."""
    out = subprocess.run([sys.executable, "-c", RUN], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout.split()[-1]) < 90
    print(out.stdout)

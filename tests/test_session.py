import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import os
from textfix.session import local_session, materialize, remove, scratch, shared_dir
spark = local_session(1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_dir(spark)
assert folder == shared_dir(spark) and os.path.isdir(folder)
with scratch(spark):
    assert materialize(spark.range(3), "probe").count() == 3
    assert os.listdir(f"{folder}/textfix")
assert not os.listdir(f"{folder}/textfix")
remove(spark, f"{folder}/textfix/absent")
print("folder", folder)
"""


def test_a_folder_is_found_without_any_spark_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    folder = done.stdout.split("folder ")[1].strip()
    assert not os.path.exists(folder)

import os
import sys

here = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, here)

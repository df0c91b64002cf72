import sys

from gapspark.cli import main

sys.exit(main())

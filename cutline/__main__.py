import sys

from cutline.cli import main

sys.exit(main())

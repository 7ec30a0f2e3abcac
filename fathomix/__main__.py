import sys

from fathomix.cli import main

sys.exit(main())

import sys

from tamarack.cli import main

sys.exit(main())

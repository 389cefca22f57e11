import sys

from matrica.cli import main

sys.exit(main())

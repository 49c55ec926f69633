import sys

from lagloom.plans.cli import main

sys.exit(main())

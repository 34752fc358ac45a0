import sys

from binstrata.cli import main

main(sys.argv[1:])

from statewave.plans.cli import main

main()
